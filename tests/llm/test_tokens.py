import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import PASSAGE, awkward, documents, empty, multiset
from tokenizers import Tokenizer

from tracewise.llm import chunk_reuse, codecs, token_counts, token_files
from tracewise.sources.tables import table

SF = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "a  b", "\n\nx \t y", "It's we'll THEY'RE don't", "ÀÉ é ﬁ İI ςΣ", "日本語 text", "<|endoftext|>x <|startoftext|>", "a\x1cb\x85c d​e",
       "12 345 ½ ² ٣", "end ", "'s", "x" * 5000, "emoji 👩‍👩‍👧 ok", "tab\tsep\r\nline", "snake_case __x__", "  　z"]


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def sample(spark):
    return [r.text for r in table(spark, SF, "documents").limit(60).collect()] + ODD


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_codec_equals_library(spark, library, path):
    c, lib = codecs.codec(path), library[path]
    for t in sample(spark):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert c.encode(t).tolist() == ids, t[:50]
        assert c.decode(np.array(ids, dtype=np.int32)) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("bits", [4, 7])
def test_joins_are_repaired(spark, library, path, bits):
    c = codecs.codec(path)
    for t in [*sample(spark), "a b   c\n\n\nd   e " * 50]:
        parts = [p.decode() for p in chunk_reuse._chunks(t.encode(), bits)]
        assert "".join(parts) == t
        got = chunk_reuse.assembled(c, [chunk_reuse.piece(p, c.encode(p)) for p in parts])
        assert got is None or got.tolist() == library[path].encode(t, add_special_tokens=False).ids
        assert got is not None or t in ODD[-1:] or len(t.split()) * 8 < len(t)


def test_chunks_depend_on_near_bytes_only():
    tail = (PASSAGE + " ") * 40
    a, b = (set(chunk_reuse._chunks(x.encode(), 6)) for x in ("some head " + tail, "another, longer head with words " + tail))
    assert len(a & b) >= 0.8 * len(a)


def test_encode_decode_equals_library(spark, library):
    lib = library[WORD]
    texts = [(i, f"{t} {PASSAGE} {i}") for i, t in enumerate(sample(spark))] + [(500, None), (501, PASSAGE * 30), (502, PASSAGE * 30), (502, PASSAGE * 30)]
    want = []
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = chunk_reuse.encode_decode(documents(spark, texts), WORD, bits=6)
    assert multiset(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert chunk_reuse.encode_decode(awkward(spark), WORD).count() == awkward(spark).count()
    assert chunk_reuse.encode_decode(empty(spark), WORD).count() == 0


def test_token_files_round_trip(spark, library, scratch):
    lib = library[BYTE]
    texts = [(i * 7 % 101, t) for i, t in enumerate(sample(spark))] + [(None, "no id"), (200, None), (200, None), (-5, "first")]
    got = token_files.token_files(documents(spark, texts), BYTE, 2).collect()
    start = 0
    by_id = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        by_id.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) in by_id[i]
    path = f"{scratch}/orc"
    token_files.write_token_files(documents(spark, texts), path, BYTE, 2)
    one = token_files.read_token_files(spark, path, [200])
    assert [r.n_tokens for r in one.collect()] == [1, 1]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,200)" in one._jdf.queryExecution().toString()
    assert token_files.token_files(awkward(spark), BYTE, 2).count() == awkward(spark).count()
    assert token_files.token_files(empty(spark), BYTE, 2).count() == 0


def slow_sections(lib, text, rule):
    spans = lib.encode(text, add_special_tokens=False).offsets
    bounds = [0, *[k + 1 for k, ch in enumerate(text) if ch == "\n" and k + 1 < len(text)], len(text)]
    out = [[0, 0, 0.0] for _ in bounds[1:]]
    for s, e in spans:
        part = [max(0, min(e, b) - max(s, a)) for a, b in zip(bounds, bounds[1:])]
        hit = [k for k, p in enumerate(part) if p]
        k = {"start": hit[0], "end": hit[-1], "majority": max(hit, key=lambda k: (part[k], -k))}[rule]
        out[k][0] += 1
        for h in hit:
            out[h][2] += part[h] / (e - s)
            out[h][1] += len(hit) > 1
    return [(n, c, round(f, 6)) for n, c, f in out]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_equal_brute_force(spark, library, rule):
    texts = [(i, t) for i, t in enumerate([*sample(spark), "a\n\n\n\nb", "x\n\n", "\n\n\n", "日\n本語\n\n字"])]
    got = {}
    for r in token_counts.section_token_counts(documents(spark, texts), BYTE, rule=rule).orderBy("doc_id", "section_no").collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.n_crossing, round(r.token_share, 6)))
    assert got == {i: slow_sections(library[BYTE], t, rule) for i, t in texts}


def test_sections_awkward_rows(spark):
    rows = token_counts.section_token_counts(awkward(spark), BYTE).collect()
    assert [(r.char_end, r.n_tokens) for r in rows if r.doc_id == 2] == [(0, 0)]
    assert sum(r.doc_id == 5 for r in rows) == 3
    assert token_counts.section_token_counts(empty(spark), BYTE).count() == 0
