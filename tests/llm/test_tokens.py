"""Token counts, ids in ORC and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tengen.llm import orc_ids, packing, subwords, token_counts

ODD = [(1, None), (2, ""), (3, " "), (4, "a  b\n\n c\t"), (4, "a  b\n\n c\t"), (None, "it's we'll I'VE '' 's"), (6, "x<|endoftext|> y"),
       (7, "a" * 5000), (8, "ab é漢字🙂  　 z" * 40), (9, "12 345,67!! ..."), (10, "word " * 6000), (11, "\x00\x1c é")]


def library(name, end=None):
    tool = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: tool.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end])


def crc(ids):
    return zlib.crc32(np.array(ids, np.uint32).tobytes())


def noise(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "th", " ", "  ", "\n", "\t", "'", "'s", "'ll", "é", "ß", "漢", "1", "23", "!!", "…", " ", "<|endoftext|>", "🙂", " '", "Σ", "_"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_transducer_matches_library():
    machine, ids = token_counts.Transducer(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    some = noise(1500) + [t for _, t in ODD if t]
    assert token_counts.count_texts(machine, [t.encode() for t in some]).tolist() == [len(ids(t)) for t in some]
    machine.reset()
    assert token_counts.count_texts(machine, [b"again", b"", b"a" * 9000]).tolist() == [1, 0, len(ids("a" * 9000))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_match_library(name):
    tool, ids = subwords.Encoder(public_tokenizers.path(name)), library(name)
    some = noise(1500, 5) + [t or "" for _, t in ODD] + ["a, b, c.", "x,y", "end.", "A! B?"]
    assert [np.frombuffer(x, np.uint32).tolist() for x in tool.ids(some)] == [ids(t) for t in some]


def test_token_counts(make, texts):
    ids = library("byte_bpe_50k.json")
    rows = ODD + texts
    got = token_counts.count_tokens(make(rows)).collect()
    want = sorted(((d, len((t or "").encode()), len(ids(t))) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(make([(1, "a")]).where("false")).count() == 0


def test_orc_round_trip(make, texts, spark, tmp_path):
    ids, rows = library("word_bpe_49k.json", 1), [(d, t) for d, t in ODD if d is not None][:4] + [(d + 100, t) for d, t in texts]
    path = str(tmp_path / "ids")
    orc_ids.write_ids(make(rows), path, files=5)
    stored = orc_ids.read_ids(spark, path)
    assert {r.doc_id: r.ids for r in stored.collect()}[100] == ids(dict(texts)[0])
    assert [r.ids for r in orc_ids.read_ids(spark, path, [150]).collect()] == [ids(dict(texts)[50])]
    got = orc_ids.digest(stored).orderBy("start").collect()
    at = 0
    for (d, t), r in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids(t)), crc(ids(t)))
        at += r.n_tokens
    odd = orc_ids.write_ids(make(ODD), str(tmp_path / "odd"), files=3)
    assert odd is None and orc_ids.digest(orc_ids.read_ids(spark, str(tmp_path / "odd"))).count() == len(ODD)
    orc_ids.write_ids(make(ODD).where("false"), str(tmp_path / "none"), files=3)
    assert orc_ids.digest(orc_ids.read_ids(spark, str(tmp_path / "none"))).count() == 0


def checked(rows, got, window):
    ids = library("byte_bpe_50k.json", 0)
    assert sum(r.length for r in got) == sum(len(ids(t)) for _, t in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, t in rows:
        want = ids(t)
        for r in by_doc[d]:
            assert r.doc_tokens == len(want) and r.ids_crc32 == crc(want[r.start:r.start + r.length])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sum(sum(r.length for r in p) < window for p in by_sequence.values()) <= 1
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing(make, texts):
    rows = list({d: (d, t) for d, t in ODD + [(d + 100, t) for d, t in texts]}.values())
    checked(rows, packing.pack(make(rows)).collect(), 1024)
    checked(rows, packing.pack(make(rows), window=64).collect(), 64)
    same = [(i, "one two three four") for i in range(300)]  # all remainders of one length
    checked(same, packing.pack(make(same), window=16).collect(), 16)
    assert packing.pack(make([(1, "a")]).where("false")).count() == 0
    twice = packing.pack(make([(5, "one two"), (5, "one two"), (None, None)])).collect()
    assert sum(r.length for r in twice) == 7


def test_counts_are_non_negative_and_fit():
    histogram = np.zeros(16)
    histogram[[4, 12, 5, 6]] = [30, 30, 10, 5]
    columns = packing.combinations(np.flatnonzero(histogram), 16)
    x = packing.solve_counts(histogram, columns)
    assert (4, 12) in columns and (5, 5, 6) in columns and (x >= 0).all()
    assert abs(x[columns.index((5, 5, 6))] - 5) < 0.3


def test_pieces_in_line_like_the_library():
    """Pieces behind a blank are encoded as they stand in a text, without marks between them."""
    tool = subwords.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["a", "Zug", "é", "1234", "can't", "'s", "'", "x,y", "日本", "🙂", "#@!", "don't.", "<|endoftext|", "ﬁ", "é", "x\x1cy", "A1-b2", "%%%", "�", "𝒳"]
    line = [f" {a}{b}" for a in words for b in ["", *words]]
    assert tool.in_line(line) == tool.whole(line)
    apart = []
    each, tool.each = tool.each, lambda p: apart.extend(p) or each(p)
    texts = [" ".join(words[i:] + words[:i]) + "\n".join(words) for i in range(len(words))] + ["", " ", "a ", " a", "a\nb c\n"]
    assert tool.ids(texts) == tool.whole(texts)
    assert apart and not [p for p in apart if p[:1] == " " and len(p) > 1]


def test_words_in_line_like_the_library():
    """Words that a tokenizer parts by white space are encoded with blanks between them, without marks, where no step before the
    model can change their length."""
    tool = subwords.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = ["a", "Zug", "\u00e9T\u00c9", "1234", "can't", "'s", "x,y", "#@!", "don't.", "A1-b2", "\u023ax", "\u0130l", "\u00aa", "</w>", "\u00bd", "\x1cx", "\x00"]
    odd = ["e\u0301", "\u65e5\u672c", "\U0001f642", "\u03a3\u03a3", "\ufb01", "x\u00a0y", "\x85z"]
    line = [a + b for a in words for b in ["", *words]]
    raw = [w.encode() for w in line]
    assert tool.words(raw, tool.tool) == tool.whole(line)
    apart = []
    each, tool.each = tool.each, lambda p: apart.extend(p) or each(p)
    texts = [" ".join(line[i:i + 40]) for i in range(0, len(line), 20)] + ["", " ", " a\n"]
    assert tool.ids(texts) == tool.whole(texts) and not apart
    texts = [" ".join([*odd[i:], *words, *odd[:i]]) + o for i, o in enumerate(odd)] + ["a<|endoftext|> b"]
    assert tool.ids(texts) == tool.whole(texts) and apart
