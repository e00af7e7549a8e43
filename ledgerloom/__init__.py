"""Ledgerloom: DataFrame operators over agent episodes, event logs and tiered memory on Spark."""
