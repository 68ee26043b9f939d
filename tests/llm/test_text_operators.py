"""Fingerprints, records, decontamination, BPE, licences, HTML and WARC against brute force."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrille.llm import _common, binary_records, bpe, decontaminate, html_extract, licenses, queries, warc, winnowing
from quadrille.llm._common import BoundedCache, emit
from quadrille.llm.html_training import labelled_pages
from tests.util import connect, same

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "Ä" * 5, "x" * 3000, "The  Cat\tsat\r\non   the mat.\n\n\nDon't <|endoftext|> stop", "日本語 テキスト 12345 €10", "İstanbul ﬁne ǅ wide space\x85end", "aaaa bbbb " * 400, "emoji 👍🏽 👨‍👩‍👧 ok", "1234 5 67,89 'LL 's", "tab\tend ", "﻿bom ᠎ \x1c fs", "same text", "same text"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def folder(spark, tmp_path, texts, **more):
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for name, df in more.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def all_texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# -- 1
def slow_winnow(text, k=winnowing.K, w=winnowing.W):
    points = [ord(c) for c in text]
    k = min(k, len(points))
    h = [int(winnowing.gram_hashes(np.array(points[i : i + k], np.uint32), k)[0]) for i in range(len(points) - k + 1)] if k else []
    w, out = min(w, len(h)), []
    for i in range(len(h) - w + 1 if h else 0):
        best = min(range(i, i + w), key=lambda j: (h[j], -j))
        if not out or out[-1] != best:
            out.append(best)
    return [h[j] for j in out], out


def test_winnow_equals_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 5, 15, 16, 17, 31, 32, 33, 200, 700):
        t = "".join(rng.choice("abé日") for _ in range(n))
        h, pos = winnowing.winnow(t)
        assert ([int(x) for x in h], pos.tolist()) == slow_winnow(t)
    t = "abcd" * 100  # ties: the rightmost minimum of a window
    assert winnowing.winnow(t)[1].tolist() == slow_winnow(t)[1]


def test_match_guarantee():
    rng = random.Random(2)
    for _ in range(20):
        shared = "".join(rng.choice("abcdef ") for _ in range(winnowing.K + winnowing.W - 1))
        a, b = ("".join(rng.choice("uvwxyz ") for _ in range(60)) + shared + "".join(rng.choice("uvwxyz ") for _ in range(40)) for _ in range(2))
        assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())


def test_op1_query(spark, tmp_path):
    for texts in (ODD, ["only one"], []):
        sf = folder(spark, tmp_path / str(len(texts)), texts)
        got = {r["doc_id"]: r for r in queries.op1_winnowing(spark, sf).collect()}
        assert sorted(got) == list(range(len(texts)))
        for i, r in got.items():
            a, b = texts[i] or "", texts[i - 1 if i else len(texts) - 1] or ""
            n = len(a)
            edited = a[: n - n // 2] + b[: n // 2]
            assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            s = [set(slow_winnow(x)[0]) for x in (a, edited, b)]
            like = lambda p, q: 1.0 if not p and not q else len(p & q) / len(p | q)
            assert abs(r["near_edited"] - like(s[0], s[1])) < 1e-12 and abs(r["near_next"] - like(s[0], s[2])) < 1e-12
            assert (r["fingerprint"] == r["edited_fingerprint"]) == (slow_winnow(a) == slow_winnow(edited))
        if texts == ODD:
            assert got[15]["fingerprint"] == got[16]["fingerprint"] != got[4]["fingerprint"]


def test_op1_over_many_ranges(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["edited_sha256"] for r in winnowing.compare_with_next(d).collect()}
    t = sorted(all_texts(spark), reverse=True)
    for (i, a), (_, b) in zip(t, t[1:] + t[:1], strict=True):
        n = len(a)
        assert got[i] == hashlib.sha256((a[: n - n // 2] + b[: n // 2]).encode()).hexdigest()


# -- 2
def test_crc32c_and_frames():
    def slow(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    bufs = [b"123456789", bytes(300), b"abcd" * 500, b"wxyz"]
    assert [int(x) for x in binary_records.crc32c(bufs)] == [slow(b) for b in bufs] and slow(b"123456789") == 0xE3069283
    data = b"".join(binary_records.frames([b"hello world", b"x" * 1000]))
    assert binary_records.unframe(data, np.array([0, 27])) == [b"hello world", b"x" * 1000]
    for at in (3, 9, 20, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            binary_records.unframe(bytes(broken), np.array([0, 27]))


@pytest.mark.parametrize("texts", [ODD, []])
def test_op2_query(spark, tmp_path, texts):
    sf = folder(spark, tmp_path, texts)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.op2_binary_records(spark, sf)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op2_whole_table(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    got = {r["doc_id"]: r for r in queries.op2_binary_records(spark, SF).collect()}
    for i, t in sorted(all_texts(spark)):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_records_in_any_order(spark):
    made = binary_records.write_records(docs(spark, [f"text number {i}" for i in range(50)]), binary_records.byte_level(public_tokenizers.path("byte_bpe_50k.json")))
    for m in made.collect():
        plain = [(i, x.tolist()) for i, x in binary_records.iter_records(m["data"], m["index"])]
        order = np.random.default_rng(0).permutation(len(plain))
        assert [(i, x.tolist()) for i, x in binary_records.iter_records(m["data"], m["index"], order)] == [plain[k] for k in order]


# -- 3
def slow_hits(text, items, window=10):
    w = decontaminate._WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, t in items:
        b = decontaminate._WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        n = min(window, len(b))
        grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(item)
    return len(w), len(hit), sorted(map(str, found))


def test_op3_query(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(3, long), (12, "Short item"), (5, None), (7, "..."), (9, "short ITEM"), (20, long + " tail")]
    texts = [None, "", "a short-item here", long.upper(), "x " + " ".join(long.split()[4:15]) + " y", " ".join(long.split()[:9]), "nothing", (long + " ") * 3]
    sf = folder(spark, tmp_path, texts, benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    for r in queries.op3_decontamination(spark, sf).collect():
        n, h, found = slow_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, h, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), h > 0)
    same(queries.op3_decontamination(spark, SF), connect(SF), queries.ORACLES["op3_decontamination"])


def test_decontaminate_blocks_modes_and_clashes(spark):
    long = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, long), (2, "one two three"), (None, "four five")], "item_id bigint, text string")
    d = docs(spark, [f"keep {long} this", "one two three", None, "four five six"]).withColumn("_hit", F.lit(1)).withColumn("item_id", F.lit("x"))
    for size in (1 << 20, 20):  # one block, several
        left = {r["doc_id"]: r for r in decontaminate.remove_hits(d, bench, block_bytes=size).collect()}
        assert left[0]["text"] == "keep  this" and left[0]["n_chars"] == 10 and left[1]["text"] == "" and left[2]["text"] is None and left[3]["text"] == " six"
        assert left[0].__fields__ == d.columns
    assert [r["doc_id"] for r in decontaminate.remove_hits(d, bench, mode="documents").collect()] == [2]
    assert decontaminate.remove_hits(d, bench.limit(0)).count() == 4


def test_columns_with_the_names_of_the_code(spark):
    """Extra columns keep their values, whatever their names; columns that are asked for replace."""
    names = ["_hits", "_hitsw", "_hit", "_hit_words", "_hit_items", "item_id"]
    d = docs(spark, ["one two three four", "five", None])
    for n in names:
        d = d.withColumn(n, F.lit(n))
    bench = spark.createDataFrame([(1, "two three"), (2, "four")], "item_id bigint, text string")
    for size in (1 << 20, 5):
        left = decontaminate.remove_hits(d, bench, block_bytes=size)
        assert left.columns == d.columns
        assert all(r[n] == n for r in left.collect() for n in names)
        found = decontaminate.find_hits(d, bench, block_bytes=size)
        assert found.columns == [c for c in d.columns if c not in ("_hit_words", "_hit_items")] + ["_hit_words", "_hit_items"]
        assert [r["_hit_items"] for r in found.orderBy("doc_id").collect()] == [[1, 2], [], []]
        assert decontaminate.report(d, bench, block_bytes=size).where("contaminated").count() == 1


def test_windows_are_small():
    """A block's windows take 24 bytes a word and 150 a distinct word, about."""
    rng = random.Random(8)
    items = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(200))) for k in range(200)]
    w = decontaminate.Windows(items, 10)
    assert sum(x.nbytes for s in w.sets.values() for x in s) + w.seq.nbytes <= 24 * 200 * 200
    mask, found = w.hits(decontaminate.words("x " + " ".join(items[7][1].split()[3:20]) + " y"))
    assert mask.tolist() == [False] + [True] * 17 + [False] and found == {7}


# -- 5
@pytest.mark.parametrize("texts", [ODD, []])
def test_op5_query(spark, tmp_path, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in queries.op5_bpe(spark, folder(spark, tmp_path, texts)).collect():
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op5_whole_table(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in queries.op5_bpe(spark, SF).collect()}
    for i, t in all_texts(spark):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoders_on_random_unicode():
    rng = random.Random(4)
    word, byte = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a, b = bpe.ForcedBoundaryEncoder(public_tokenizers.path("word_bpe_49k.json")), binary_records.ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    pools = ["abcDEF 'st12\n", "äöüßÉèñ ÀŸſ", "".join(map(chr, range(0x20, 0x3FF))), "".join(map(chr, range(0x1E00, 0x2100))), "日本語가나다👍🏽‍́ͅ  \t\r"]
    for _ in range(1500):
        t = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60)))
        ids = word.encode(t, add_special_tokens=False).ids
        assert a.ids(t) == ids, repr(t)
        assert a.encode(t)[2] == word.decode(ids, skip_special_tokens=False), repr(t)
        assert np.frombuffer(b(t), "<u4").tolist() == byte.encode(t, add_special_tokens=False).ids, repr(t)


def test_forced_pairs_never_cut_a_token():
    pairs = bpe.forced_pairs(["ab", "bc</w>", "x"], "</w>")
    assert pairs == {"ab", "bc"}


def test_bounded_cache():
    c = BoundedCache(lambda k: k * 2, 10_000)
    for k in range(1000):
        key = str(k % 137)
        assert c[key] == key * 2
        assert c.used <= 10_000 and c.used == sum(180 + len(a) + len(b) for a, b in c.items())
    assert c["x" * 65] == "x" * 130 and "x" * 65 not in c
    c.clear()
    assert c.used == 0


def test_encoders_keep_few_bytes():
    a, b = bpe.ForcedBoundaryEncoder(public_tokenizers.path("word_bpe_49k.json"), 40_000), binary_records.ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"), 40_000)
    for k in range(2000):
        text = f"word{k} Other{k}! " + "z" * 5000
        assert len(a.ids(text)) > 9 and len(b(text)) > 9
    for coder in (a, b):
        assert sum(c.used for c in coder.caches) <= 40_000 and all(len(key) <= 64 for c in coder.caches for key in c)


def test_emit_by_weight():
    schema = pa.schema([("a", pa.string())])
    got = [b.num_rows for b in emit((("x" * n,) for n in (5, 5, 50, 1, 1)), schema, weigh=lambda r: len(r[0]), most=10)]
    assert got == [2, 1, 2]


# -- 6
def test_op6_query(spark, tmp_path):
    same(queries.op6_license_scan(spark, SF), connect(SF), queries.ORACLES["op6_license_scan"])
    texts = [None, "", "All rights reserved.", "prose\nReleased under the MIT license!\nmore", "licensed", licenses.TEMPLATES[1][1].upper(), licenses._MIT.replace("\n", " ") + " extra words here", "word " * 5000, "Licensed under the MIT license\nReleased under the MIT license"]
    sf = folder(spark, tmp_path, texts)
    got = {r["doc_id"]: r for r in queries.op6_license_scan(spark, sf).collect()}
    assert [got[i]["license"] for i in range(9)] == [None, None, "Proprietary", "MIT", None, "Apache-2.0", "MIT", None, "MIT"]
    assert got[3]["unit"] == 1 and got[3]["dice"] == 1.0 and got[8]["n_matches"] >= 2 and got[8]["unit"] == 0
    same(queries.op6_license_scan(spark, sf), connect_dir(sf), queries.ORACLES["op6_license_scan"])


def slow_run(text):
    """The best Dice of any run of words, by trying all of them."""
    w, best = re.findall("[a-z0-9]+", text.lower()), (0.0, "")
    seq = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    for name, b in sorted(licenses.template_bigrams(), key=lambda x: x[0]):
        b = set(b)
        for i in range(len(seq)):
            have, same_ = set(), 0
            for x in seq[i : i + 300]:
                same_ += x in b and x not in have
                have.add(x)
                if 2 * same_ / (len(have) + len(b)) > best[0]:
                    best = (2 * same_ / (len(have) + len(b)), name)
    return best if best[0] >= licenses.THRESHOLD else (None, None)


def test_license_runs(spark):
    rng, fill = random.Random(3), lambda n: " ".join(rng.choice(["under", "the", "software", "license", "of", *(f"w{rng.randrange(999)}" for _ in range(5))]) for _ in range(n))
    texts = []
    for grant in (licenses._MIT, licenses._ISC, licenses._APACHE, licenses._GPL):
        w = grant.split()
        texts.append("\n".join([fill(60), *(" * " + " ".join(w[k : k + 9]) for k in range(0, len(w), 9)), fill(70), fill(80)]))
        texts.append("\n".join([fill(9), *(" ".join(["x", *w[k : k + 13]]) for k in range(0, len(w), 13)), fill(300)]))
        texts.append(fill(100) + "\n" + "\n".join(w[: len(w) // 3]) + "\n" + fill(100))
    texts += ["This project is licensed under the MIT License.", f"{fill(40)} is released\nunder the MIT\nlicense {fill(40)}", "The rights are reserved by all of us, and this is long enough text"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        dice, name = slow_run(t)
        assert (got[k]["license"], got[k]["dice"]) == (name, pytest.approx(dice) if name else None), t
        assert got[k]["unit"] == (-2 if name else None)
    assert [got[k]["license"] for k in (0, 3, 6, 9, 12, 13, 14)] == ["MIT", "ISC", "Apache-2.0", "GPL-3.0", "MIT", "MIT", None]
    # What a line stands for is no run too; a grant around a line is.
    two = ["prose of some length here\nThis work is licensed under the GNU General Public License, version 3.\nand more prose of some length", f"{fill(50)}\nLicensed under the Apache License, Version 2.0\n" + "\n".join(licenses._APACHE.split()[8:]) + f"\n{fill(50)}"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, two)).collect()}
    assert (got[0]["unit"], got[0]["n_matches"]) == (1, 1) and (got[1]["license"], got[1]["unit"], got[1]["n_matches"]) == ("Apache-2.0", 1, 2)


def test_license_bodies(spark):
    """A body wrapped over lines, with text before and after it."""
    import textwrap

    bodies = {"BSD-3-Clause": f"{licenses._BSD_2} {licenses._BSD_3} {licenses._BSD_END}", "BSD-2-Clause": f"{licenses._BSD_2} {licenses._BSD_END}", "LGPL-3.0": licenses._LGPL, "Unlicense": licenses._UNLICENSE, "MIT": licenses._MIT}
    texts = ["Some words of a file.\n" + textwrap.fill(b, 60) + "\nMore lines follow.\nAnd more." for b in bodies.values()]
    got = {r["doc_id"]: (r["license"], r["unit"]) for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert [got[i][0] for i in range(len(texts))] == list(bodies)
    clash = docs(spark, [texts[0], None, texts[0]]).withColumn("units", F.lit(1)).withColumn("run", F.lit("x")).withColumn("doc_id", F.lit(7))
    assert sorted(r["license"] or "" for r in licenses.scan_licenses(clash).collect()) == ["", "BSD-3-Clause", "BSD-3-Clause"]
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def connect_dir(sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    return con


# -- 7
def test_op7_query(spark, tmp_path):
    same(queries.op7_warc(spark, SF), connect(SF), queries.ORACLES["op7_warc"])
    big = "<p>" + "payload " * 30 + "</p>"
    pages = [(5, "http://a/", big), (2, None, big), (9, "http://b/\r\nX: y", big), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", "ä" * 60), (7, "u", "ä" * 60)]
    folder(spark, tmp_path, [], pages=spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    got = {r["page_id"]: r for r in queries.op7_warc(spark, str(tmp_path)).collect()}
    assert {i: r["refers_to"] for i, r in got.items()} == {5: 2, 2: None, 9: 2, 1: None, 3: None, 4: None, 6: None, 7: 6}
    for i, _, html in pages:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[i]["record_type"] == "revisit") == (got[i]["refers_to"] is not None)


def test_op7_long_hot_and_repeated_pages(spark, tmp_path, monkeypatch):
    """One payload on most rows, empty and null pages, a long page, a repeated id; and no rows."""
    monkeypatch.setattr(_common, "HOT_ROWS", 3)
    long, same_html = "<p>long</p>" * 40_000, "<p>the same page</p>" * 9
    rows = [(i, "u", same_html, "x") for i in range(30)] + [(i, "u", None, "x") for i in range(30, 50)] + [(50, "u", long, "x"), (51, None, long, "x"), (51, None, long, "x"), (52, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, key string")
    folder(spark, tmp_path, [], pages=pages)
    got = queries.op7_warc(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] < 30) == [(0, "response", None)] + [(i, "revisit", 0) for i in range(1, 30)]
    assert {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"] >= 50} == {(50, "response", None, len(long)), (51, "revisit", 50, len(long)), (52, "response", None, 0)}
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(pages.limit(0)), b"")).count() == 0


def test_empty_documents(spark, tmp_path):
    sf = folder(spark, tmp_path, [], benchmark=spark.createDataFrame([(1, "a b")], "item_id bigint, text string"))
    for name in ("op3_decontamination", "op6_license_scan", "op10_minhash"):
        assert queries.QUERIES[name](spark, sf).count() == 0


def test_null_and_repeated_ids_of_op1_and_op2(spark, tmp_path):
    """Ids are ordered; repeated ones by text; a null id comes last in op1 and first in op2."""
    rows = [(5, "five five five"), (None, "no id"), (5, "a five"), (9, "nine"), (1, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    order = [(9, "nine"), (5, "five five five"), (5, "a five"), (1, ""), (None, "no id")]
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in queries.op1_winnowing(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    got = queries.op2_binary_records(spark, str(tmp_path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 5, 5, 9] and got[2]["n_tokens"] < got[3]["n_tokens"] + 2


def test_archive_round_trip_and_damage():
    rec = warc.record(7, "http://x/ä", b"<p>hi</p>", hashlib.sha256(b"<p>hi</p>").hexdigest(), None)
    assert warc.parse(rec)["payload"] == b"<p>hi</p>" and warc.parse(rec)["url"] == "http://x/ä"
    for bad in (rec[:-1], rec.replace(b"hi", b"ho"), rec.replace(b"WARC/1.1", b"WARC/9.9"), rec.replace(b"WARC-Date", b"WARC-Dote"), rec.replace(b"Content-Length: 9", b"Content-Length: 8")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    words = zstandard.train_dictionary(1024, [rec + bytes([k]) * 40 for k in range(200)]).as_bytes()
    for frame in (words, zstandard.ZstdCompressor().compress(words)):
        body = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words)).compress(rec)
        file = b"\x5d\x2a\x4d\x18" + len(frame).to_bytes(4, "little") + frame + body * 3
        assert [r["page_id"] for r in warc.iter_archive(io.BytesIO(file))] == [7, 7, 7]
        with pytest.raises(ValueError):
            list(warc.iter_archive(io.BytesIO(file[:-3])))
        with pytest.raises(ValueError):
            list(warc.iter_archive(io.BytesIO(b"x" + file)))


# -- 9
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header class="site-header"><div>Site name</div><form><input><button>Go</button></form></header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site better for every one of our readers.</p></div>
<div class="layout"><main><article><header><h1>Head &amp; line</h1></header>
<p>First   paragraph of the
article, with <b>bold</b> and a <a href="/x">link</a> in it.<p>Second&nbsp;paragraph &eacute;.</p>
<div class="ad">Buy now and save a lot of money today with our offer!</div>
<div style="overflow:hidden"><ul><li>point one</li><li>point two</li></ul></div></article>
<section id="comments"><h2>Comments</h2><p>A reader wrote a long comment here that is no part of the article itself.</p></section></main>
<aside><p>Related stories that are somewhere else on the site, told at some length.</p></aside></div>
<footer>&copy; 2024 Example. All rights reserved.</footer></body></html>"""


def test_html_open_head_form_and_page_class():
    para = "Some words of running text. " * 8
    want = "Title here " + para.strip() + " Short end."
    inner = f"<article><h1>Title here</h1><p>{para}</p><p>Short end.</p></article>"
    top = "<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8><style>p{}</style>"
    for page in (
        f"{top}<body>{inner}</body></html>",
        f"{top}{inner}",
        f"{top}<noscript><img src=a></noscript><body>{inner}",
        f"{top}</head><body><form id=aspnetForm action=x><input><select><option>One</select><button>Go</button><textarea>a</textarea>{inner}</form></body></html>",
        f"{top}</head><body class='has-sidebar page nav-open'>{inner}</body></html>",
        f"<html class='menu' id=legal><head></head><body id=side>{inner}",
    ):
        assert html_extract.extract(page) == want, page
    assert html_extract.extract(f"{top}</head><body>{inner}<form class=search><label>Find</label><input><button>Go</button></form></body>") == want


def test_html_page():
    want = "Head & line First paragraph of the article, with bold and a link in it. Second paragraph é. point one point two"
    assert html_extract.extract(PAGE) == want
    bare = "<div><h1>Title here</h1><p>" + "Some words of running text. " * 8 + "</p></div><ul class=menu><li><a href=a>A</a></ul>"
    assert html_extract.extract(bare) == "Title here " + ("Some words of running text. " * 8).strip()


def errors(pages, smooth):
    w, wrong, changed = html_extract.weights(), 0, 0
    for html, label in pages:
        found = html_extract.blocks(html)
        alone = [a > b for a, b in html_extract.costs(found, w)]
        side = html_extract.labels(found, w, smooth) if smooth else alone
        wrong += sum(s != label[b.text] for s, b in zip(side, found, strict=True))
        changed += sum(s != a for s, a in zip(side, alone, strict=True))
    return wrong, changed


def test_the_cut_decides_labels():
    """On pages that were not trained on, the cut changes labels, and errors get fewer."""
    for style in ("parts", "bare"):
        pages = list(labelled_pages(150, seed=11, styles=(style,)))
        before, after = errors(pages, 0)[0], errors(pages, html_extract.SMOOTH)
        assert after[1] > 10 and after[0] < before
    total = list(labelled_pages(200, seed=12))
    assert errors(total, html_extract.SMOOTH)[0] <= 0.02 * sum(len(x) for _, x in total)


def test_class_words_never_drop_an_article():
    para = "Some words of running text, and some more of them. " * 6
    inner = f"<h1>Title here</h1><p>{para}</p><p>Yes.</p><p>{para}more</p>"
    want = f"Title here {para.strip()} Yes. {para}more"
    top, end = "<nav><a href=a>Home</a><a href=b>News</a></nav>", "<footer>© 2020 Some site.</footer>"
    for names in ("post tag-news", "content no-comments", "article has-sidebar", "post-12 category-ads", "story with-share-buttons", "entry legal", "news-comments main"):
        for tag in ("article", "main", "div"):
            assert html_extract.extract(f"<body>{top}<{tag} class='{names}'>{inner}</{tag}>{end}") == want, (tag, names)
    for names in ("sidebar-layout", "with-footer", "header-fixed page"):
        assert html_extract.extract(f"<body><div class='{names}'>{top}<article>{inner}</article>{end}</div>") == want


def test_html_other_templates():
    para = "Some words of running text, and some more of them. " * 5
    text = f"Title here {para.strip()}"
    inner = f"<h1>Title here</h1><p>{para}</p>"
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About us</a></li></ul>"
    for page in (
        f"<div id=nav>{menu}</div><div id=content>{inner}</div><div id=footer>© 2020 All rights reserved.</div>",
        f"<div class=site-nav>{menu}</div><div class=site-content>{inner}<div class=ad>Buy this now.</div></div><div class=site-footer><p>Copyright 2020 Us.</p></div>",
        f"<table><tr><td>{menu}</td><td>{inner}</td></tr></table>",
        f"<header>{menu}</header><main>{inner}</main><aside><p>Read these other things.</p></aside><section class=comments><p>I do not think that this is right at all.</p></section>",
        f"<div role=navigation>{menu}</div><div role=main>{inner}</div><div role=contentinfo>Some words here.</div>",
        f"<main>{inner}</main><div class='cookie'><p>We use cookies on this site. Read our terms of use.</p></div>",
        f"<article>{inner}<form class=newsletter><p>Subscribe to our newsletter.</p><label>Mail</label><input></form></article>",
    ):
        assert html_extract.extract(f"<html><body>{page}</body></html>") == text, page


def test_html_long_and_deep_pages():
    many = "".join(f"<p>Paragraph {k} of a very long page, with words.</p>" for k in range(4000))
    got = html_extract.extract(f"<nav><a href=a>A</a></nav><article>{many}</article>")
    assert got.startswith("Paragraph 0 of") and got.endswith("3999 of a very long page, with words.") and got.count("Paragraph") == 4000
    assert html_extract.extract("<div>" * 20_000 + "Some words in it.") in ("Some words in it.", "")


def test_op9_repeated_ids_and_empty_pages(spark, tmp_path):
    schema = "page_id bigint, url string, html string, text string, cost int"
    rows = [(1, "u", PAGE, "mine", 1), (1, "u", PAGE, "mine", 1), (1, "v", "", None, None)]
    folder(spark, tmp_path, [], pages=spark.createDataFrame(rows, schema))
    got = queries.op9_html_extraction(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["n_chars"] > 0 for r in got.collect()) == [False, True, True]
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_min_cut_is_optimal():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 8)
        t = [(rng.randrange(5), rng.randrange(5)) for _ in range(n)]
        e = [(a, b, rng.randrange(1, 4)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda side: sum(t[k][0] if not side >> k & 1 else t[k][1] for k in range(n)) + sum(c for a, b, c in e if (side >> a & 1) != (side >> b & 1))
        got = html_extract.min_cut([(float(a), float(b)) for a, b in t], [(a, b, float(c)) for a, b, c in e])
        assert cost(sum(1 << k for k in range(n) if got[k])) == min(map(cost, range(1 << n)))


def test_op9_query(spark, tmp_path):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>tag"), (5, "u", "no markup at all"), (6, "u", "<article><p>cut</p><p>tag <a hre"), (None, "u", "<script>x</script>")]
    folder(spark, tmp_path, [], pages=spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    got = {r["page_id"]: r for r in queries.op9_html_extraction(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert [got[i]["text"] for i in (2, 3, None)] == ["", "", ""] and got[6]["text"] == "cut tag" and got[4]["text"] == "unclosed tag"


def test_op9_on_pages(spark):
    """The pages are of one kind: heading and paragraphs of the article are the text."""
    import re
    from html import unescape

    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op9_html_extraction(spark, SF).collect():
        body = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", x))).strip() for x in re.split(r"</?(?:h1|p|br)\b[^>]*>", body)]
        assert r["text"] == " ".join(x for x in parts if x)
