from delaylake.llm import chat as op


def brute(rows, part):
    out = []
    first = lambda x: (x is not None, x if x is not None else "")
    rows = set(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, first(r[2]), first(r[3])))
        for who in {r[2] for r in mine} - {None, "system"}:
            for p in range(-(-len(mine) // part)):
                text, masks, number = "", [], 0
                for _, _, role, said in mine[p * part : (p + 1) * part]:
                    if role == who:
                        head = "<|assistant|>\n"
                    elif role == "system":
                        head = "<|system|>\n"
                    else:
                        head = "<|user|>\n" if role is None else f"<|user name={role.replace('<|', '< |')}|>\n"
                    body = (said or "").replace("<|", "< |") + "<|end|>\n"
                    text += head
                    if role == who:
                        masks.append((len(text), len(text) + len(body)))
                    text += body
                    number += 1
                out.append((conv, who, p, number, text, masks))
    return sorted(out, key=str)


ROWS = [
    (1, 0, "ann", "hello"), (1, 1, "bob", "hi 🙂 é"), (1, 2, "ann", None), (1, 3, "system", "note"), (1, 4, "<|x|>", "a <|end|> b"), (1, 4, "ann", "tie"), (1, 4, "ann", "tie"),
    (1, 9, None, "who"), (1, None, "bob", "no turn"), (2, 0, "system", "alone"), (None, 0, "cat", ""), (None, 5, "dog", "x" * 100_000), (3, 700, "ann", "late"), (3, 1, "bob", "early"),
]


def test_against_brute_force(spark):
    turns = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "conv_id long, turn long, role string, text string, perspective string, part int")
    for part in (2, 256):
        got = sorted(((r["conv_id"], r["perspective"], r["part"], r["n_messages"], r["text"], [tuple(m) for m in r["masks"]]) for r in op.rotate(turns, part=part).collect()), key=str)
        assert got == brute(ROWS, part)
    assert op.rotate(turns.limit(0)).count() == 0


def test_masks_cover_the_speaker_only(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    for r in op.rotate(turns).collect():
        for a, b in r["masks"]:
            assert r["text"][:a].endswith("<|assistant|>\n") and r["text"][a:b].endswith(op.CLOSE)
            assert "<|" not in r["text"][a : b - len(op.CLOSE)]


def test_a_turn_that_many_messages_share_is_split(spark):
    turns = spark.createDataFrame([(1, 0, "ann" if i % 2 else "bob", f"m{i}") for i in range(600)], "conv_id long, turn long, role string, text string")
    found = op.rotate(turns).collect()
    assert sorted((r["perspective"], r["part"], r["n_messages"]) for r in found) == [(w, p, n) for w in ("ann", "bob") for p, n in ((0, 256), (1, 256), (2, 88))]
