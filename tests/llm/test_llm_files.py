"""Token files, WARC archives and packing: exact round trips and defined edge cases."""

import gzip
import hashlib
import io
import os
import struct
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_helpers import docs, rows, same_as_sql  # noqa: E402

from tabflow.llm import packing, tokenfile, warc  # noqa: E402
from tabflow.llm.common import shared_folder  # noqa: E402

SF = "/root/testdata/sf0.001"


# --- token files -----------------------------------------------------------------------------------------------

def test_ids_of_a_chunk_of_odd_and_plain_texts_equal_the_librarys():
    import random
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces, plain = tokenfile.Pieces(path), Tokenizer.from_file(path)
    rng = random.Random(21)
    bits = ["a", "Zeit", "é", "7", "_", ",", ".", "!", "'s", " ", " ", " ", "\n", "\t", "\u00a0", "\u3000", "漢", "\x1c", "\r", "²", "\u0301"]
    texts = ["", " ", "\n", ",", "a,,b", "a!,b", "a_,b", "a ,b", "a\n,b", "a, b. c\nd", "x\0y", "a,", "a.\n", "<|endoftext|>, a"]
    texts += ["".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(1500)]
    texts += [" ".join(rng.choices(["Haus", "a,", "b.", "c", "d,e", "²."], k=9)) for _ in range(300)]
    for again in range(2):  # all pieces new, then all known
        ids, lens = pieces.encode(texts, 2)
        want = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert lens.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    # A chunk is cut by Arrow and looks every distinct piece up once.
    pieces.clear()
    seen = []
    pieces.numbers, numbers = (lambda found: numbers(seen.append(found := list(found)) or found)), pieces.numbers
    pieces.encode(["the same words, again and again"] * 50, None)
    assert [len(x) for x in seen if x] == [len(set(seen[-1]))] == [6]


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 3000])
@pytest.mark.parametrize("kind", ["random", "same", "text"])
def test_block_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"random": rng.integers(0, 50257, n), "same": np.full(n, 50256), "text": rng.zipf(1.3, n) % 500}[kind]
    out = tokenfile.encode_block(ids)
    mark, count, lanes, length, crc = struct.unpack("<4sIIII", out[:20])
    assert (mark, count, length, crc) == (b"BLOK", n, len(out) - 20, zlib.crc32(out[20:]))
    assert (tokenfile.decode_block(count, lanes, out[20:]) == ids).all()


def test_predictable_ids_take_few_bits():
    ids = np.tile(np.arange(100), 300)
    assert len(tokenfile.encode_block(ids)) * 8 / len(ids) < 3


def test_order0_is_counted_per_build_not_per_step(monkeypatch):
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 50257, 9000), rng.zipf(1.3, 11_000) % 500])
    wide, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, minlength=0: (wide.append(minlength), count(x, minlength=minlength))[1])
    out = tokenfile.encode_block(ids)
    assert wide.count(50257) <= 16  # one for each of 256 steps before
    # The bytes of the format did not change with it.
    assert (len(out), zlib.crc32(out)) == (30768, 3880249870)
    assert (tokenfile.decode_block(len(ids), struct.unpack("<I", out[8:12])[0], out[20:]) == ids).all()


def test_a_failed_encoding_leaves_no_number_without_ids(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    pieces = tokenfile.Pieces(public.path("byte_bpe_50k.json"))
    want = [x.tolist() for x in pieces.encode(["one two", "three"], 2)]
    pieces.clear()
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(pieces, "ids_of", lambda texts: (_ for _ in ()).throw(RuntimeError("worker lost")))
        pieces.encode(["one two", "three"], 2)
    assert [x.tolist() for x in pieces.encode(["one two", "three"], 2)] == want


def test_pieces_equal_whole_text_encoding():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    pieces = tokenfile.Pieces(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list("abZé3 .,'!\n\t\r\x00\x1c 　ß_-|<>中")), max_size=40))
    def check(text):
        ids, lens = pieces.encode([text, "a b", text], None)
        want = whole.encode(text, add_special_tokens=False).ids
        assert ids[:lens[0]].tolist() == want and ids[lens[0] + lens[1]:].tolist() == want

    check()
    # Every blank Python knows, single and in pairs, around line breaks and words; special tokens.
    import random
    rng = random.Random(6)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    units = ["a", "b.", ",c", "x", "\n", " ", "<|endoftext|>", "<|endoftext|", "é1"]
    texts = ["line one\n\xa0\xa0line two", "a\r\n\xa0\tb", "abc <|endoftext|> def"]
    texts += [f"a{x}{y}{z}b" for x in blanks for y in blanks for z in ("", "\n", " ")]
    texts += ["".join(rng.choice(units if rng.random() < 0.7 else blanks) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    ids, lens = pieces.encode(texts, None)
    want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert lens.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def expect_tokens(pairs):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, text in pairs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def tokens_of(spark, df, **kw):
    import public_tokenizers
    folder = shared_folder(spark, "t")
    files = tokenfile.write_tokens(df, folder, public_tokenizers.path("byte_bpe_50k.json"), **kw)
    return tokenfile.read_tokens(files, folder), folder


def test_token_files_edge_cases(spark):
    texts = ["one two.", None, "", "  spaces \n\n here", "long " * 9000, "rep eat", "nul \x00 byte"]
    got, _ = tokens_of(spark, docs(spark, texts, extra=True))
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == expect_tokens(enumerate(texts))
    twice, _ = tokens_of(spark, docs(spark, ["x y", "x y", "z"], ids=[7, 7, None]))
    assert sorted(rows(twice, "n_tokens", "ids_crc32")) == sorted((n, c) for _, _, n, c in expect_tokens([(None, "z"), (7, "x y"), (7, "x y")]))
    empty, _ = tokens_of(spark, docs(spark, []))
    assert empty.count() == 0


def test_token_file_damage_is_found(spark):
    got, folder = tokens_of(spark, docs(spark, ["some words to keep safe"] * 3), files=1)
    assert got.count() == 3
    from tabflow.llm.common import list_files, task_fs
    name = list_files(folder, ".tkm")[0][0]
    fs, path = task_fs(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        raw = bytearray(f.read())
    raw[40] ^= 1
    with pytest.raises(ValueError):
        (_, blocks) = tokenfile.read_file(io.BytesIO(bytes(raw)), len(raw))
        list(blocks)


def test_op1_whole_table(spark):
    import duckdb
    d = duckdb.connect().execute(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet') ORDER BY doc_id").fetchall()
    got = tokenfile.op1_tokenfile(spark, SF)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == expect_tokens(d)


# --- WARC ------------------------------------------------------------------------------------------------------

def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, body string, digest string, refers_to int")


def test_warc_edge_cases_and_splits(spark):
    big = "x" * 200
    long = "".join(chr(97 + i * i % 26) for i in range(300_000))
    data = [(3, "http://a/ b\r\n", big), (1, None, None), (2, "u", ""), (9, "u", big), (5, "u", "short"), (6, "u", "short"), (None, "u", big),
            (8, "é", long), (10, "u", "naïve – text" * 20), (3, "again", big)]
    df = pages(spark, [(*r, "c", "c", 1) for r in data])
    folder = shared_folder(spark, "w")
    warc.write_warc(df, folder)
    want = []
    for p, u, h in data:
        b = (h or "").encode()
        ref = 3 if h == big and p != 3 else None
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref else "response", ref))
    key = lambda t: tuple((x is None, str(x)) for x in t)
    for split in (97, 5000, 1 << 22):
        got = warc.read_warc(spark, folder, split_bytes=split)
        assert sorted(rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), key=key) == sorted(want, key=key)
    texts = {r.page_id: r.payload for r in got.where("record_type = 'response'").collect()}
    assert bytes(texts[8]) == long.encode() and bytes(texts[1]) == b""


def test_warc_is_plain_gzip_members_and_empty_table(spark):
    one = warc.record_bytes(4, "http://x/", b"<p>hi</p>", hashlib.sha256(b"<p>hi</p>").hexdigest(), None, "1970-01-01T00:00:00Z")
    text = gzip.decompress(one)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response") and text.endswith(b"<p>hi</p>\r\n\r\n")
    folder = shared_folder(spark, "w")
    assert warc.write_warc(pages(spark, []), folder).count() == 0


def test_warc_false_magic_and_damage():
    good = warc.record_bytes(1, "u", b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest(), None, "d")
    noise = b"\x1f\x8b\x08 not a member " + gzip.compress(b"plain gzip, no record")
    raw = noise + good + noise + good
    found = [o for o, _ in warc.scan_range(io.BytesIO(raw), len(raw), 0, len(raw))]
    assert found == [len(noise), 2 * len(noise) + len(good)]
    # Every record is owned by exactly one of any ranges that cover the file.
    for step in (7, 50, 211):
        parts = [o for s in range(0, len(raw), step) for o, _ in warc.scan_range(io.BytesIO(raw), len(raw), s, s + step)]
        assert parts == found
    cut = good[:-30]
    with pytest.raises(ValueError):
        list(warc.scan_range(io.BytesIO(cut), len(cut), 0, len(cut)))


def test_op2_sql(spark):
    same_as_sql(warc.op2_warc(spark, SF), warc.OP2_SQL, SF)


# --- packing ---------------------------------------------------------------------------------------------------

def check_packing(out, lengths, sizes):
    bins = {}
    for r in out:
        bins.setdefault((r.bin_id, r.bin_size, r.bin_used), []).append(r)
    assert len({k[0] for k in bins}) == len(bins)
    for (_, size, used), items in bins.items():
        items.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in items:
            assert r.bin_offset == at
            at += r.n_tokens
        assert at == used <= size and size == min(s for s in sizes if s >= used)
    per = {}
    for r in out:
        per.setdefault(r.doc_id, []).append((r.piece, r.start, r.n_tokens))
    assert {d: sum(x[2] for x in p) for d, p in per.items()} == lengths


def test_packing_places_every_token(spark):
    rng = np.random.default_rng(1)
    lengths = {i: int(x) for i, x in enumerate(rng.integers(1, 700, 400))}
    lengths[400] = 5000
    df = spark.createDataFrame([(i, n, "c", 1, 2) for i, n in lengths.items()], "doc_id long, len long, bin_id string, n int, piece int")
    for block in (50, 100_000):
        out = packing.pack(df, (64, 128, 512), length_col="len", block_items=block).collect()
        check_packing(out, lengths, (64, 128, 512))


def test_packing_is_near_the_best_of_small_cases():
    import itertools
    rng = np.random.default_rng(2)
    sizes, fee = [8, 12, 20], 1

    def brute(items):
        best = [10 ** 9]

        def go(k, loads):
            if k == len(items):
                best[0] = min(best[0], sum(next(s for s in sizes if s >= u) + fee for u in loads))
                return
            for b in range(len(loads) + 1):
                new = list(loads) + [0] * (b == len(loads))
                new[b] += items[k]
                if new[b] <= sizes[-1]:
                    go(k + 1, new)
        go(0, [])
        return best[0]

    for _ in range(20):
        items = sorted((int(x) for x in rng.integers(1, 15, 6)), reverse=True)
        where, final, used = packing.pack_block(items, sizes, fee)
        assert sum(used) == sum(items) and all(u <= f for u, f in zip(used, final))
        assert sum(final) + fee * len(final) <= 1.5 * brute(items)
    assert itertools


def test_packing_edge_cases(spark):
    out = packing.pack(docs(spark, [None, "", "a b c", "a b c", "w " * 40], extra=True, ids=[0, 1, 2, 2, None]), (8, 16)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.n_tokens) for r in out)
    assert got == [(False, 0, 0, 1), (False, 1, 0, 1), (False, 2, 0, 4), (False, 2, 0, 4), (True, 0, 0, 16), (True, 0, 1, 16), (True, 0, 2, 9)]
    assert packing.pack(docs(spark, []), (8,)).count() == 0
