"""Token counts, BPE codec and packing against the public libraries."""

import base64
import hashlib
import zlib

import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import bpe, bpe_codec, packing, queries, token_counts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
HARD = ["", "it's they'll 'tis we've''s  's\n's  x", "  a  b\n\n c \t d   ", "x" * 3000 + " aaaa aaa aa", " 123abc٣٤ é日本語   x", "'S'll'lll'r'v've", "<|endoftext|> a<|endoftext|>b", "a <|endoftext|>  <|endoftext", "!!!'s ...'t '", "don't'", "'re", "   ", "\n"]


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def run(texts, path, special=False):
    out = []
    for _, ids, first in bpe.encode_blocks(path, [pa.record_batch({"text": pa.array(texts, pa.string())})], "text", special):
        out += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def test_replay_equals_library(tik, library):
    assert run(HARD, RANKS) == [tik.encode_ordinary(x) for x in HARD]
    assert run(HARD, JSON, True) == [library.encode(x, add_special_tokens=False).ids for x in HARD]


_encoding = None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_categories=["Cn"]), st.sampled_from(" '\n\tstrevlmd aA1é"))), max_size=5))
def test_replay_equals_library_on_any_text(texts):
    global _encoding
    if _encoding is None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        _encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert run(texts, RANKS) == [_encoding.encode_ordinary(x) for x in texts]


def docs(spark):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(50, None), (3, "again"), (3, "again"), (None, "no key"), (60, "one two three " * 30_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n_tokens", F.lit("clash")).withColumn("length", F.lit(3))


def test_codec_digests(spark, tik):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.digests(docs(spark), RANKS).collect())
    want = []
    for r in docs(spark).collect():
        ids = tik.encode_ordinary(r.text or "")
        want.append((r.doc_id if r.doc_id is not None else -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = bpe_codec.decode(bpe_codec.encode(docs(spark), RANKS), RANKS).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((r.text or "").encode() for r in docs(spark).collect())
    assert bpe_codec.digests(docs(spark).filter("false"), RANKS).count() == 0


def test_counts_equal_library(spark, library):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(spark), JSON).collect())
    want = []
    for r in docs(spark).collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert token_counts.token_counts(docs(spark).filter("false"), JSON).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 40), (1000, 1)])
def test_spliced_counts_equal_whole_ones(name, chunk, overlap):
    own = token_counts.tokens(P.path(name))
    text = "Ünïcode words, and 3 numbers: don't stop\n\n  indented line. 日本語 mixed  in 😀 emoji " * 20 + "x" * 700 + " tail of words " * 30 + "<|endoftext|> end"
    for t in (text, "no-spaces-at-all" * 60, " " * 500, "a b " * 300):
        assert token_counts.count_tokens(own, t, chunk, overlap) == own.count(t)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab cé\n'st 1😀"), min_size=60, max_size=400))
def test_any_splice(text):
    own = token_counts.tokens(JSON)
    assert token_counts.count_tokens(own, text, 40, 6) == own.count(text)


def check_packing(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plan_places_every_count(counts):
    rows = packing.plan(counts, 64)
    placed, by_length = [], {}
    for length, rank, each, base, offset in rows:
        by_length.setdefault(length, []).append((rank, each, base, offset))
    for length, n in counts.items():
        slots = sorted(by_length[length])
        for r in range(n):
            rank, each, base, offset = [s for s in slots if s[0] <= r][-1]
            placed.append({"sequence_id": base + (r - rank) // each, "offset": offset + (r - rank) % each * length, "length": length})
    used = check_packing(placed, 64)
    bins = []  # best-fit decreasing, one piece at a time
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= length]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= length
        else:
            bins.append(64 - length)
    assert used == len(bins)


def test_packed_documents(spark, library):
    d = docs(spark)
    rows = packing.pack_documents(d, JSON, 32).collect()
    check_packing(rows, 32)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for r in d.collect():
        if r.doc_id in (3,):
            continue
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[r.doc_id], key=lambda x: x["piece"])
        assert [x["piece"] for x in own] == list(range(len(own))) and sum(x["length"] for x in own) == len(ids)
        at = 0
        for k, x in enumerate(own):
            part = ids[at : at + x["length"]]
            assert x["start"] == at and (k == 0 or x["length"] == 32) and x["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += x["length"]
    repeated = [len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in d.collect() if r.doc_id == 3]
    assert len(repeated) > 1 and len(pieces[3]) == sum(-(-n // 32) for n in repeated)
    assert packing.pack_documents(d.filter("false"), JSON, 32).count() == 0


def test_packing_is_tight(spark):
    rows = queries.op9_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    used = check_packing(rows, 1024)
    assert used <= 1.01 * -(-sum(r["length"] for r in rows) // 1024) + 1
