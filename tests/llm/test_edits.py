import random

import public_tokenizers
from tokenizers import Tokenizer

from sluice.llm import edits as E


def _tokenizer():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return tok


def test_edits_match_counting_anew():
    tok, rng = _tokenizer(), random.Random(9)
    counter = E.PieceCounter.of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bits = ["a", "word", " ", "  ", "\n", "'s", "'", "12", "!", "é", "你", " the", "\t", "<|endoftext|>", " "]
    for trial in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 120)))
        tree = E.TokenTree(text, counter, block=rng.choice([1, 3, 64]))
        for _ in range(12):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + 8))
            new = "".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text
            assert [p for n in E._blocks(tree.root) for p in n.pieces] == counter.pattern.findall(text)
            assert tree.tokens == len(tok.encode(text, add_special_tokens=False).ids)


def test_edits_touch_little():
    counter = E.PieceCounter.of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tree = E.TokenTree("some words of a long text " * 20_000, counter)
    for i in range(50):
        tree.edit(i * 10_000, i * 10_000 + 3, "new words")
    assert tree.reencoded < 50 * 10


def test_query_rows(spark):
    tok = _tokenizer()
    rows = [(1, None), (2, ""), (3, "x"), (None, "Hello  world's"), (3, "x"), (4, "long text " * 30_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in E.edited_counts(df).collect()), key=str)
    want = []
    for doc_id, text in rows:
        text = old = text or ""
        for a, b, new in E.sample_edits(doc_id, len(text)):
            text = text[:a] + new + text[b:]
        n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
        want.append((doc_id, n(old), 3, len(text), n(text)))
    assert sorted(((g[0], g[2], g[3], g[4], g[5]) for g in got), key=str) == sorted(want, key=str)
    assert E.edited_counts(df.limit(0)).count() == 0


def test_counts_agree_with_the_tokenizer_on_any_code_point():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counter = E.PieceCounter.of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    unsure = [0x558, 0x58B, 0x88F, 0x208F, 0xA7CE, 0xA7F1, 0x10940, 0x11DE0, 0x12550, 0x187F8, 0x1D6A6, 0x323B0, 0x3D000, 0x1C, 0x85, 0x3000, 0x2028]
    ids = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for _ in range(60):
        text = "".join(chr(rng.choice(unsure)) if rng.random() < 0.3 else rng.choice("ab 1'st!  \n") for _ in range(rng.randint(1, 200)))
        tree = E.TokenTree(text, counter, block=4)
        assert tree.tokens == ids(text)
        for _ in range(10):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 9))
            new = "".join(rng.choice(["a", " ", "1", chr(rng.choice(unsure))]) for _ in range(rng.randint(0, 5)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text and tree.tokens == ids(text)
    for start in range(0x80, 0x40000, 4096):
        text = "".join(f"a{c}a {c}1" for c in map(chr, range(start, start + 4096)) if not 0xD800 <= ord(c) < 0xE000)
        assert E.TokenTree(text, counter).tokens == ids(text), hex(start)
