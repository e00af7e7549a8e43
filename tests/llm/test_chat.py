import hashlib

from ledgerloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "be kind \\ <b>"),
    (1, 1, "user", "a\\lb [x] </s><s>[user]"),
    (1, 2, "assistant", "fine\n\\b\\\\ ]<image:0>"),
    (1, 3, "assistant", "\\"),
    (2, 0, "user", None),
    (2, 1, "assistant", ""),
    (3, 5, "we[ir]d\\r", "😀 ß"),
    (3, None, None, "first"),
    (None, 0, "assistant", "alone"),
    (4, 0, "user", "same"),
    (4, 0, "user", "same"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_round_trip(spark):
    out = chat.read_back(chat.format_chat(chat.text_parts(frame(spark)))).collect()
    groups = {}
    for c, turn, role, text in ROWS:
        groups.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert {r.conv_id for r in out} == set(groups) and len(out) == len(groups)
    for r in out:
        want = sorted(groups[r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [w[1:] for w in want]
        assert r.learnt == "".join(w[2] for w in want if w[1] == "assistant")


def test_masks_point_into_the_string(spark):
    for r in chat.format_chat(chat.text_parts(frame(spark))).collect():
        segments = r.formatted.split(chat.OPEN)[1:]
        for s in r.loss_spans:
            under = r.formatted[s.start : s.start + s.length]
            assert under == segments[s.turn][s.offset - len(chat.OPEN) :][: s.length]
            assert r.formatted[s.start + s.length :].startswith(chat.CLOSE)


def test_parts(spark):
    parts = [("text", "see <", None, None), ("image", None, "s3://a.png", 4), ("audio", "x", "b.wav", 10), None, ("text", "and", None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("document", None, "c.pdf", 2), ("text", "ok", None, None)]), (1, 2, "user", None), (1, 3, "user", [("vi<d>eo[", "", "d", 3)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    (out,) = chat.format_chat(df).collect()
    assert out.formatted == "<s>[user]see \\l<image:0><audio:1>and</s><s>[assistant]<document:2>ok</s><s>[user]</s><s>[user]<vi\\ld\\geo\\s:3></s>"
    assert [tuple(a) for a in out.attachments] == [(0, 0, "image", "s3://a.png", 85 + 4 * 170), (1, 0, "audio", "b.wav", 250), (2, 1, "document", "c.pdf", 2400), (3, 3, "vi<d>eo[", "d", 0)]
    (back,) = chat.read_back(chat.format_chat(df)).collect()
    assert [t.text for t in back.turns] == ["see <and", "ok", "", ""] and back.learnt == "ok"


def test_query_adds_the_adversarial_conversation(spark, tmp_path):
    frame(spark).withColumn("segment", chat.F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-7].loss_chars == len(said) and got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[3].loss_chars == 0 and got[3].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty(spark):
    assert chat.format_chat(chat.text_parts(frame(spark, []))).count() == 0
