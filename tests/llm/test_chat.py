import hashlib
import random

from sluice.llm import chat as C


def test_escape_is_reversible():
    rng = random.Random(0)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "im_end", ">", C.END, C.START, "é", "\n"]) for _ in range(rng.randint(0, 12)))
        safe = C.escape(text)
        assert C.restore(safe) == text and "<|" not in safe


def test_round_trip_and_mask(spark):
    rng = random.Random(3)
    bits = ["Hello", " ", "\n\n", "!", "<|im_end|>", "<|endoftext|>", "<\\|", "👩‍👩‍👧 ", "ñ", "  ", "<", "|", "12", "你好", "'s"]
    rows = [(-1, 0, "user", C.END + C.START + "assistant ok"), (-1, 1, "assistant", C.END + C.START + "assistant ok")]
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "", C.END])
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))])
            rows.append((conv if conv else None, turn, role, text))
    rows.append((500, None, "assistant", "x " * 100_000))
    rows += [(501, 1, "assistant", "twice")] * 2
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, ids int").repartition(4)
    got = {r.conv_id: r for r in C.format_conversations(df, digest=True).collect()}
    want = {}
    for conv_id, turn, role, text in rows:
        want.setdefault(conv_id, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert got.keys() == want.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv_id, turns in want.items():
        turns = sorted(turns, key=lambda t: t[0])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv_id]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_outputs_decode_to_the_rendering(spark):
    rows = [(1, 0, "user", "Hi there"), (1, 1, "assistant", "Général Kenobi <|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = C.format_conversations(df).collect()
    tok = C.chat_tokenizer()
    assert tok.decode(r.ids, skip_special_tokens=False) == r.formatted
    assert C.restore(tok.decode([i for i, m in zip(r.ids, r.loss) if m])) == rows[1][3]
    assert C.format_conversations(df.limit(0)).count() == 0


def test_fast_offsets_are_the_tokenizer_s():
    rng, fast, slow = random.Random(5), C.OffsetEncoder.of(), C.OffsetEncoder()
    slow.fast = None
    bits = ["Hello", " ", "\n\n", "!", "ñ", "日", "  ", "<", "\\|", "12", "ß", "'s", "é́", "₿", " the", C.START, C.MIDDLE, C.END, "\t", "½", "€"]
    used = 0
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        used += not C.UNSURE.search(text)
        for a, b in zip(fast.encode(text), slow.encode(text)):
            assert a.tolist() == b.tolist(), text
    assert used > 20
