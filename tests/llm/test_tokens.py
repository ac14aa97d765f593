"""Encoding, decoding, attribution and files of token ids."""

import hashlib
import random
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallywork.llm import attribution, binary, bytebpe, common, queries, segments
from support import DOCUMENT, EDGE, JSON, MULTI, SF, documents

ODD = ["a", "B", " ", "  ", "\n", " \n", "\t", "é", "漢", "🙂", "'s", "'ll", "1", "22", "..", "!!", "ing", "the", "́", "\x00", "‍", "ع", "　", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.read_ranks(open(MULTI, "rb").read())


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=segments.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return tokenizer


def texts(n: int = 3000):
    rnd = random.Random(3)
    return ["".join(rnd.choices(ODD, k=rnd.randint(1, 16))) for _ in range(n)] + ["a" * 3000, " " * 2000, "ab" * 900, "\n" * 90 + "x"]


def test_transducer_equals_tiktoken(plain):
    own = bytebpe.RankSegments(open(MULTI, "rb").read())
    encoder = segments.TextEncoder(segments.pieces, own.encode, own.word, room=50)
    for text in texts():
        assert np.frombuffer(encoder.encode(text), segments.IDS).tolist() == plain.encode_ordinary(text), repr(text)


def test_transducer_forgets_states(monkeypatch, plain):
    monkeypatch.setattr(bytebpe, "MAX_STATES", 50)
    own = bytebpe.RankSegments(open(MULTI, "rb").read())
    encoder = segments.TextEncoder(segments.pieces, own.encode, own.word)
    for text in texts(300):
        assert np.frombuffer(encoder.encode(text), segments.IDS).tolist() == plain.encode_ordinary(text)


def test_transducer_bounds_forbidden_sets(monkeypatch, plain):
    """Equal sets are kept once, beyond the states' reset, and are forgotten by a bound of their own."""
    monkeypatch.setattr(bytebpe, "MAX_STATES", 200)
    monkeypatch.setattr(bytebpe, "MAX_FORBIDDEN", 100, raising=False)
    own, most = bytebpe.RankSegments(open(MULTI, "rb").read()), 0
    encoder = segments.TextEncoder(segments.pieces, own.encode, own.word, room=50)
    for text in texts(1000)[:1000]:
        assert np.frombuffer(encoder.encode(text), segments.IDS).tolist() == plain.encode_ordinary(text), repr(text)
        known = own._transducer._forbidden
        assert len({id(tokens) for tokens in known.values()}) == len(set(known.values()))
        most = max(most, len(known))
    # one match is looked at whole before sets are forgotten
    assert 100 < most < 200


def test_large_batches_are_cut_in_order():
    """A worker's arrays are several times the text it takes at once, so a batch above the wanted size goes in parts."""
    sizes = [10, 3, 0, 300, 1, 40, 40, 40]
    kinds = pa.schema([("key", pa.int64()), ("text", pa.string())])
    rows = [pa.record_batch([list(range(n)), ["x" * (n + i % 7) for i in range(n)]], kinds) for n in sizes]
    parts = list(common.gathered(iter(rows), 5000))
    back = pa.Table.from_batches(parts).to_pylist()
    assert back == pa.Table.from_batches(rows).to_pylist()
    assert max(part.nbytes for part in parts) < 2 * 5000 + 1000 and min(part.nbytes for part in parts[:-1]) >= 5000


def test_fits_is_what_merging_says(ranks):
    merges, rnd = bytebpe.Merges(ranks), random.Random(4)
    tokens = sorted(t for t in ranks if len(t) < 7)
    for _ in range(20_000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        assert merges.fits(a, b) == (merges.merge(a + b) == [a, b]), (a, b)


def test_utf8_machine_in_pieces():
    rnd = random.Random(5)
    for data in ["aé漢🙂" * 5, "plain"]:
        raw = data.encode()
        for _ in range(50):
            machine, at, out = bytebpe.Utf8Machine(), 0, ""
            while at < len(raw):
                step = rnd.randint(1, 4)
                out += machine.feed(raw[at : at + step])
                at += step
            assert out + machine.end() == data
    for raw in (b"\xff", b"a\xe2\x82", b"\xed\xa0\x80x", b"\xf0\x9f\x98", b"\xc0\xaf", b"\xe2\x28\xa1"):
        machine = bytebpe.Utf8Machine()
        assert "".join(machine.feed(bytes([b])) for b in raw) + machine.end() == raw.decode("utf-8", "replace")


def test_op9_edges_and_round_trip(spark, plain):
    docs = documents(spark)
    rows = bytebpe.encode_and_decode(docs, MULTI).collect()
    want = sorted((-1 if i is None else i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in EDGE)
    got = sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in rows)
    assert got == want and all(r.n_tokens == len(r.ids) // 4 for r in rows)
    back = bytebpe.decode(bytebpe.encode(docs, MULTI), MULTI).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in EDGE)
    assert bytebpe.encode_and_decode(spark.createDataFrame([], DOCUMENT), MULTI).count() == 0


def test_op9_query(spark, plain):
    texts_by_id = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in queries.op9_byte_bpe(spark, SF).collect():
        ids = plain.encode_ordinary(texts_by_id[row.doc_id] or "")
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((texts_by_id[row.doc_id] or "").encode()).hexdigest()


def test_library_segments_equal_the_library(library):
    own = segments.LibrarySegments(open(JSON, "rb").read())
    encoder = segments.TextEncoder(own.match, own.encode, own.word, room=50)
    for text in [*texts(), "x <|endoftext|> y"]:
        assert np.frombuffer(encoder.encode(text), segments.IDS).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def mixed_texts():
    rnd = random.Random(8)
    mixed = ["".join(rnd.choices([*ODD, "word", "Bär", *" " * 12], k=30)) for _ in range(1000)]
    return [*texts(1000), *mixed, "", None, " ", " a", "a ", "x <|endoftext|> y", "a" * 100 + " b", "漢 " * 50]


@pytest.mark.parametrize("room", [0, 50, 100_000])
def test_batches_equal_the_library(library, room):
    own = segments.LibrarySegments(open(JSON, "rb").read())
    encoder = segments.BatchEncoder(segments.TextEncoder(own.match, own.encode, own.word, room=50), room)
    rows = mixed_texts()
    for start in range(0, len(rows), 700):
        some = rows[start : start + 700]
        for text, ids in zip(some, encoder.encode(pa.array(some, pa.string())), strict=True):
            assert np.frombuffer(ids, segments.IDS).tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert list(encoder.encode(pa.array([], pa.string()))) == []


def test_batches_equal_tiktoken(plain):
    own = bytebpe.RankSegments(open(MULTI, "rb").read())
    encoder = segments.BatchEncoder(segments.TextEncoder(segments.pieces, own.encode, own.word, room=50), 50)
    rows = mixed_texts()
    for text, ids in zip(rows, encoder.encode(pa.array(rows, pa.string())), strict=True):
        assert np.frombuffer(ids, segments.IDS).tolist() == plain.encode_ordinary(text or ""), repr(text)


def test_batches_encode_each_match_once(library):
    own, asked = segments.LibrarySegments(open(JSON, "rb").read()), []
    single = segments.TextEncoder(own.match, lambda m: asked.append(m) or own.encode(m), lambda w: asked.append(" " + w) or own.word(w))
    encoder = segments.BatchEncoder(single)
    for _ in range(2):
        list(encoder.encode(pa.array(["a bird, a bird!", "a bird.\nA bird; bird"])))
    behind = [match for match in asked if match.startswith(" ")]
    assert sorted(behind) == [" a", " bird"]


def test_workers_memory_is_bounded():
    """What a worker keeps per different word; two generations of a dictionary took some 400 bytes."""
    own = segments.LibrarySegments(open(JSON, "rb").read())
    encoder = segments.BatchEncoder(segments.TextEncoder(own.match, own.encode, own.word, room=10), 5000)
    letters = np.array(list("abcdefghijklmnop"))
    for batch in range(5):
        words = ["".join(letters[[i >> s & 15 for s in range(0, 20, 4)]]) for i in range(batch * 4000, batch * 4000 + 4000)]
        list(encoder.encode(pa.array([" ".join(["x", *words])])))
    known = encoder._matches
    assert len(known._texts) == len(known._sizes) == 5000 and known._sizes.sum() == len(known._ids)
    assert pa.concat_arrays([known._texts]).nbytes + known._ids.nbytes + known._sizes.nbytes < 60 * 5000


def files(spark, docs, **parameters):
    folder = f"{tempfile.mkdtemp()}/ids"
    binary.write(docs, folder, JSON, **parameters)
    return folder


def test_op5_edges(spark, library):
    folder = files(spark, documents(spark), end_id=0)
    rows = sorted(binary.read(spark, folder).collect(), key=lambda r: r.start)
    want = sorted((-1 if i is None else i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in EDGE)
    got = [(-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
    assert sorted(got) == want and [g[0] for g in got] == [w[0] for w in want]
    total = 0
    for row in rows:
        assert row.start == total and row.n_tokens == len(row.ids) // 4
        total += row.n_tokens
    one = binary.lookup(spark, folder, [9, 6, 99]).collect()
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in one) == [w for w in want if w[0] in (6, 9)]


def test_op5_empty_table_and_wrong_dictionary(spark):
    folder = files(spark, spark.createDataFrame([], DOCUMENT), end_id=0)
    assert binary.read(spark, folder).count() == 0
    spark.createDataFrame([("no hash", bytearray(b"x"))], binary.DICTIONARY).coalesce(1).write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(ValueError):
        binary.read(spark, folder)


def test_op5_query_and_dictionary_is_used(spark, library):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    start = 0
    for row in sorted(queries.op5_token_files(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = np.array([*library.encode(source[row.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = files(spark, spark.read.parquet(f"{SF}/documents.parquet"), end_id=0)
    dictionary = spark.read.parquet(f"{folder}/dictionary").first()
    assert len(dictionary.content) > 0
    assert {r.dictionary for r in spark.read.parquet(f"{folder}/shards").collect()} == {dictionary.hash}


def test_op5_many_shards(spark, monkeypatch):
    monkeypatch.setattr(binary, "SHARD_DOCUMENTS", 7)
    folder = files(spark, spark.read.parquet(f"{SF}/documents.parquet"), end_id=0)
    rows = sorted(binary.read(spark, folder).collect(), key=lambda r: r.doc_id)
    assert spark.read.parquet(f"{folder}/shards").count() >= len(rows) // 7
    total = 0
    for row in rows:
        assert row.start == total
        total += row.n_tokens


def brute_allot(offsets, spans, rule):
    counts = [0.0] * len(spans)
    for a, b in offsets:
        overlap = [max(0, min(b, e) - max(a, s)) for s, e in spans]
        touched = [i for i, o in enumerate(overlap) if o > 0]
        if not touched:
            counts[max([i for i, (s, _) in enumerate(spans) if s < b], default=0)] += 1
        elif rule == "split":
            for i in touched:
                counts[i] += overlap[i] / sum(overlap)
        else:
            counts[{"first": touched[0], "last": touched[-1]}.get(rule, max(touched, key=lambda i: (overlap[i], -i)))] += 1
    return counts


@pytest.mark.parametrize("rule", attribution.RULES)
def test_op1_against_offsets_of_the_library(spark, library, rule):
    docs = documents(spark)
    rows = attribution.count_tokens(docs, JSON, rule=rule).collect()
    texts_left = {}
    for i, t, *_ in EDGE:
        texts_left.setdefault(i, []).append(t or "")
    assert len(rows) == len(EDGE)
    for row in rows:
        text = texts_left[row.doc_id][0]
        code = library.encode(text, add_special_tokens=False)
        spans = attribution.sentences(text)
        assert row.n_tokens == len(code.ids) and row.n_sections == len(spans)
        if len(text) < 5000:
            assert row.section_tokens == pytest.approx(brute_allot(code.offsets, spans, rule))
        assert sum(row.section_tokens) == pytest.approx(row.n_tokens if spans else 0)


def test_op1_given_spans_with_gaps(spark, library):
    text = "Heading one\n\nSome bodytext here, and 漢字 more.\nTail"
    spans = [(0, 4), (13, 17), (17, 22), (30, 31), (40, 48)]
    table = spark.createDataFrame([(1, a, b) for a, b in spans], "doc_id BIGINT, start INT, end INT")
    docs = attribution.with_spans(spark.createDataFrame([(1, text), (2, None), (3, "no spans")], "doc_id BIGINT, text STRING"), table)
    rows = {r.doc_id: r for r in attribution.count_tokens(docs, JSON, sections="spans").collect()}
    assert rows[1].section_tokens == brute_allot(library.encode(text, add_special_tokens=False).offsets, spans, "most")
    assert rows[2].n_tokens == 0 and rows[3].n_sections == 0 and rows[3].n_tokens > 0
    with pytest.raises(ValueError):
        attribution.count_tokens(docs, JSON, rule="none")


def test_op1_query(spark, library):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_token_attribution(spark, SF).collect()
    assert len(rows) == len(source)
    for row in rows[:60]:
        text = source[row.doc_id]
        if len(text) < 4000:
            code = library.encode(text, add_special_tokens=False)
            assert row.section_tokens == brute_allot(code.offsets, attribution.sentences(text), "most")
