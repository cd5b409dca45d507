from odd_rows import rows_of

from claimgraph.llm import chat as C

ROWS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello\nthere"), (1, 3, "ann", None), (1, 300, "cid", "late 😀"),
        (1, 2, "bob", "hello\nthere"), (2, None, "ann", "no turn"), (2, 5, None, "no role"), (3, 0, "system", "alone"),
        (None, 1, "ann", "no conversation"), (4, 0, "bob", "")]


def brute():
    out = []
    for conv in {r[0] for r in ROWS}:
        messages = sorted(((t, r or "unknown", x or "") for c, t, r, x in ROWS if c == conv),
                          key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
        for speaker in {m[1] for m in messages} - {"system"}:
            text = ""
            for k, (turn, role, content) in enumerate(messages):
                name = "assistant" if role == speaker else "system" if role == "system" else f"user name={role}"
                head = f"<|im_start|>{name}\n"
                part = f"{head}{content}<|im_end|>\n"
                mask = (len(text) + len(head), len(text) + len(part) - 1) if role == speaker else (None, None)
                out.append((conv, speaker, k + 1, turn, role, content, part, len(text), *mask))
                text += part
    return sorted(out, key=repr)


def test_every_perspective(spark):
    rows = [(*r, "clash", 1) for r in ROWS]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, key string, block int").repartition(3)
    assert rows_of(C.perspectives(df)) == brute()
    assert rows_of(C.perspectives(df.where("turn = -1"))) == []


def test_masks_cover_what_the_speaker_says(spark):
    df = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string")
    rows = C.perspectives(df).where("conv_id = 1 and speaker = 'ann'").orderBy("segment").collect()
    text = "".join(r["rendered"] for r in rows)
    said = [text[r["mask_start"]:r["mask_end"]] for r in rows if r["mask_start"] is not None]
    assert said == ["hi<|im_end|>", "<|im_end|>"]
