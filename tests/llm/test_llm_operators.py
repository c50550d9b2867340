"""Each corpus operator against a plain version, on odd rows and on the given tables."""

import base64
import hashlib
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import (
    decontaminate,
    language,
    packing,
    quality,
    repeats,
    simhash,
    token_counts,
    token_files,
    url_filter,
    warc,
)
from folioscope.llm.components import connected_components
from folioscope.llm.shared import scratch_folder, table

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use inside; documents may have such columns too.
CLASHES = ("words", "row", "print", "part", "hash", "carried", "kept", "n_words", "lang_pred")
ODD_TEXTS = [
    None, "", " ", "  a", "a ", "a  b", "a\n b \t c\n", "a<|endoftext|> b <|startoftext|>x",
    "don't I'LL we've 's 't", "日本語 テスト", "12.5 ½ ²", "\x1c a\x1fb \x85 \xa0c", "🙂 👍🏽",
    "a" * 3000, "İΣ ΑΣ ß é e\u0301x", "<|endoftext|>", "\n\n\n", "x " * 5000,
]


def documents(spark, rows, source="s"):
    schema = "doc_id long, text string, source string, lang string"
    docs = spark.createDataFrame([(i, t, source, "en") for i, t in rows], schema)
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


def given(spark):
    return table(spark, SF, "documents")


def pairs(docs):
    return [(x.doc_id, x.text) for x in docs.collect()]


@pytest.fixture(scope="module", params=["odd", "given", "empty"])
def docs(request, spark):
    if request.param == "given":
        return given(spark)
    rows = documents(spark, brute.texts(1, 60, 60))
    return rows.limit(0) if request.param == "empty" else rows


def test_quality_counts(docs):
    found = quality.judge(docs).collect()
    want = dict(pairs(docs))
    assert len(found) == len(want)
    for x in found:
        counts = (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)
        assert counts == brute.quality(want[x.doc_id])
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words)


def test_bad_hosts_lose_their_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 20 == 0 else "short", "bad") for i in range(200)]
    rows += [(1000 + i, good if i % 20 else "short", "fine") for i in range(200)]
    rows += [(2000, good, "new"), (2001, good, None), (2002, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {x.doc_id: x.kept for x in quality.judge(docs).collect()}
    assert not kept[0] and kept[1001] and not kept[1000]
    assert kept[2000] and kept[2001] and not kept[2002]


def test_token_counts_are_the_librarys(spark):
    rows = list(enumerate(ODD_TEXTS)) + [(100 + i, t) for i, t in pairs(given(spark))]
    want = Tokenizer.from_file(BYTES).encode_batch(
        [t or "" for _, t in rows], add_special_tokens=False
    )
    found = token_counts.count_tokens(documents(spark, rows), BYTES).collect()
    assert {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in found} == {
        i: (len((t or "").encode()), len(w), len(w) > 1024) for (i, t), w in zip(rows, want)
    }
    assert not token_counts.count_tokens(given(spark).limit(0), BYTES).collect()


def test_merges_in_a_run_go_from_the_left():
    merger = token_counts.Merger(BYTES)
    library = Tokenizer.from_file(BYTES)
    for n in range(1, 40):
        assert merger.count(["a" * n]) == [len(library.encode("a" * n))]


def plain_fingerprint(text, size=3):
    found = (text or "").encode().translate(simhash.LOWER).split()
    if not found:
        return 0
    grams = [b" ".join(found[i : i + size]) for i in range(len(found) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams or [b" ".join(found)]]
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def test_near_duplicates(docs):
    rows = [(i, plain_fingerprint(t)) for i, t in pairs(docs)]
    found = simhash.near_duplicates(docs).collect()
    want = brute.components(rows, 2)
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in found} == {
        i: (f"{p:016x}", want[i]) for i, p in rows
    }


def test_all_close_pairs_are_found_once(spark):
    draw = np.random.default_rng(5)
    prints = set()
    for base in draw.integers(0, 1 << 63, 12):
        for _ in range(40):
            value = int(base)
            for bit in draw.integers(0, 64, draw.integers(0, 4)):
                value ^= 1 << int(bit)
            prints.add(value - (1 << 64) if value >> 63 else value)
    rows = spark.createDataFrame([(p,) for p in prints], "print long")
    for radius in (1, 2, 3):
        links = simhash.find_links(simhash.meeting_places(rows, radius), radius).collect()
        found = [tuple(sorted((x.a, x.b))) for x in links]
        want = {
            (min(a, b), max(a, b))
            for a in prints
            for b in prints
            if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius
        }
        assert len(found) == len(set(found)) and set(found) == want


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(found) == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_repeats(docs):
    for window in (4, 13):
        found = repeats.remove_repeats(docs, window, part_docs=9, carry=("lang",)).collect()
        want = brute.without_repeats(pairs(docs), window)
        assert {x.doc_id: (x.n_words, x.n_removed, x.text) for x in found} == want


@pytest.mark.parametrize("first, levels", [(1, [1, 2, 4, 8, 13]), (3, [3, 6, 12, 13]), (20, [13])])
def test_repeats_by_more_levels(spark, first, levels):
    assert repeats.lengths(13, first) == levels
    docs = documents(spark, brute.texts(1, 60, 60))
    want = brute.without_repeats(pairs(docs), 13)
    found = repeats.remove_repeats(docs, part_docs=9, first=first).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.text) for x in found} == want
    # Nothing repeats, so no candidate survives a level.
    other = documents(spark, [(i, " ".join(f"{i}w{k}" for k in range(40))) for i in range(30)])
    assert {x.n_removed for x in repeats.remove_repeats(other, first=first).collect()} == {0}


def test_repeats_leave_rows_without_id_and_untouched_texts(spark):
    same = " ".join(f"w{i}" for i in range(20))
    rows = [(None, same), (2, same), (2, same), (5, f"new\n\n{same}"), (6, "own  text")]
    found = repeats.remove_repeats(documents(spark, rows), rejoin=False).collect()
    assert sorted((x.doc_id or 0, x.n_removed, x.text) for x in found) == [
        (0, 0, same), (2, 0, same), (2, 0, same), (5, 20, "new"), (6, 0, "own  text"),
    ]


def test_contamination(docs, spark):
    schema = "item_id long, text string"
    items = [(i, t) for i, t in brute.texts(2, 12, 25)] + [(None, "b a b a b a b a b a b")]
    for some in (items, [x for x in items if len((x[1] or "").split()) >= 10], []):
        found = decontaminate.find_contamination(docs, spark.createDataFrame(some, schema))
        want = brute.contamination(pairs(docs), some)
        assert {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in found.collect()} == want


def test_contamination_of_the_given_documents(spark):
    items = table(spark, SF, "benchmark")
    want = brute.contamination(
        pairs(given(spark)), [(x.item_id, x.text) for x in items.collect()]
    )
    found = decontaminate.find_contamination(given(spark), items).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in found} == want
    assert any(x.n_hit for x in found)


def ids_of(rows, path):
    library = Tokenizer.from_file(path)
    found = library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return {i: np.array([*x.ids, 2], dtype="<u4").tobytes() for (i, _), x in zip(rows, found)}


@pytest.mark.parametrize(
    "limits", [packing.Limits(), packing.Limits(256, 3, 100), packing.Limits(4096, 2, 4096)]
)
def test_packing(spark, limits):
    rows = list(enumerate(ODD_TEXTS)) + [(100 + i, t) for i, t in pairs(given(spark))]
    docs = documents(spark, rows).withColumn("quiet", F.lit(10)).repartition(3)
    found = packing.pack(docs, WORDS, limits, quiet_col="quiet").collect()
    whole, sequences = defaultdict(bytes), defaultdict(list)
    for x in sorted(found, key=lambda x: x.start):
        assert x.start * 4 == len(whole[x.doc_id]) and x.length * 4 == len(x.ids) > 0
        whole[x.doc_id] += bytes(x.ids)
        sequences[x.sequence_id].append(x)
    assert whole == ids_of(rows, WORDS)
    assert all(len(whole[x.doc_id]) == 4 * x.doc_tokens for x in found)
    for pieces in sequences.values():
        end = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == end
            end += x.length
        loss = sum(max(0, x.start + x.length - max(x.start, 10)) for x in pieces)
        assert end <= limits.tokens and len(pieces) <= limits.segments
        assert loss <= limits.loss_tokens
        full = len(pieces) == limits.segments or loss == limits.loss_tokens
        assert full or end == limits.tokens or end & (end - 1) == 0
    assert not packing.pack(docs.limit(0), WORDS).collect()


def test_packing_of_very_short_documents(spark):
    """Sequences of one-id documents are full too, where the segments may be as many as the ids."""
    docs = spark.range(0, 10_000, numPartitions=2).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    found = packing.pack(docs, WORDS, packing.Limits(segments=4096))
    lengths = [x.n for x in found.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(lengths) == 10_000 and all(n == 4096 or n & (n - 1) == 0 for n in lengths)


def test_token_files(spark):
    rows = list(enumerate(ODD_TEXTS)) + [(100 + i, t) for i, t in pairs(given(spark))]
    want, folder = ids_of(rows, BYTES), scratch_folder(spark, "tokens")
    token_files.write_tokens(documents(spark, rows).repartition(3), folder, BYTES)
    found = {x.doc_id: x for x in token_files.read_summary(spark, folder).collect()}
    counts = {x.doc_id: x.start for x in token_files.read_counts(spark, folder).collect()}
    start = 0
    for doc in sorted(want):
        x = found[doc]
        assert (x.start, 4 * x.n_tokens) == (start, len(want[doc])) and counts[doc] == start
        assert x.ids_crc32 == zlib.crc32(want[doc])
        start += x.n_tokens
    one = token_files.read_tokens(spark, folder, [3]).collect()
    assert [np.array(x.tokens, "<u4").tobytes() for x in one] == [want[3]]


def test_token_files_of_nothing_and_of_rows_without_id(spark):
    folder = scratch_folder(spark, "tokens")
    token_files.write_tokens(given(spark).limit(0), folder, BYTES)
    assert not token_files.read_summary(spark, folder).collect()
    folder = scratch_folder(spark, "tokens")
    token_files.write_tokens(documents(spark, [(None, "a"), (1, "b"), (1, "b")]), folder, BYTES)
    found = token_files.read_summary(spark, folder).collect()
    assert sorted((x.doc_id or 0, x.start) for x in found) == [(0, 0), (1, 2), (1, 4)]


def test_warc_round_trip(spark):
    rows = [(x.page_id, x.url, x.html) for x in table(spark, SF, "pages").collect()]
    rows += [(9000 + i, "http://copy", h) for i, (_, _, h) in enumerate(rows[:9])]
    rows += [(9100, None, None), (9101, "http://a\r\nb: c", ""), (9102, "", "é\r\n\r\n" * 9)]
    rows += [(9103, "http://big", "x" * 3_000_000), (9104, "u", rows[0][2]), (9104, "u", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumn("digest", F.lit("clash")).repartition(3)
    for least in (0, 1, 10_000):
        low = {}
        for page, _, html in rows:
            low[html or ""] = min(low.get(html or "", page), page)
        folder = scratch_folder(spark, "archives")
        index = warc.write_archives(pages, folder, least_bytes=least)
        found = warc.read_records(index, folder).collect()
        want = []
        for page, url, html in rows:
            raw = (html or "").encode()
            first = low[html or ""]
            again = len(raw) >= least and first < page
            digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
            target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
            kind = "revisit" if again else "response"
            want.append((page, target, kind, len(raw), digest, first if again else None, None if again else raw))
        got = [tuple(x[:6]) + (None if x[6] is None else bytes(x[6]),) for x in found]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    some = index.where("page_id in (9101, 3)")
    assert {x.page_id for x in warc.read_records(some, folder).collect()} == {9101, 3}
    assert not warc.round_trip(spark, pages.limit(0), scratch_folder(spark, "archives")).collect()


def test_ranges_are_fetched_together():
    near = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP_BYTES, 5)]
    far = [("a", 10**9, 5), ("b", 10**9 + 5, 5)]
    runs = [near, far[:1], far[1:]]
    assert list(warc.coalesced(near + far)) == runs


def test_language_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").repartition(4)
    langs = {x.doc_id: x.lang for x in docs.collect()}
    odd = documents(spark, [(10**6, None), (10**6 + 1, "12 -- !"), (10**6 + 2, "the " * 200_000)])
    found = language.identify(docs.unionByName(odd, allowMissingColumns=True)).collect()
    for x in found:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
    judged = {x.doc_id: x.lang_pred for x in found}
    held = [x.doc_id for x in found if x.held_out and x.doc_id in langs]
    assert sum(judged[i] == langs[i] for i in held) >= 0.98 * len(held) > 100
    assert [judged[10**6 + i] for i in range(3)] == ["und", "und", "en"]


def test_language_with_nothing_to_learn(spark):
    docs = documents(spark, [(1, "some text"), (None, "more")]).withColumn("lang", F.lit(None))
    found = language.identify(docs.withColumn("lang", F.col("lang").cast("string"))).collect()
    assert [(x.lang_pred, x.score) for x in found] == [("und", 0.0)] * 2
    assert not language.identify(docs.limit(0)).collect()


def test_url_filter(spark):
    urls = [
        "http://A.Example.NET/en/x?q#f", "http://example.net/fr", "http://net", "http://net/",
        "x://y.example.com/de/1", "https://www.listed.io/p/", "https://listed.io/p?utm_source=z",
        "http://org/fr/", "no scheme", "", None, "http://notexample.net/en/", "https://listed.io/q",
        "http://listed.io/p",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    want = [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("example.net", "/fr", "net/", "block"),
        ("net", "", None, "allow"),
        ("net", "/", "net/", "block"),
        ("y.example.com", "/de/1", "example.com/de/", "block"),
        ("www.listed.io", "/p/", None, "block"),
        ("listed.io", "/p", None, "block"),
        ("org", "/fr/", "org/fr/", "allow"),
        *[("", "", None, "allow")] * 3,
        ("notexample.net", "/en/", "net/", "block"),
        ("listed.io", "/q", None, "allow"),
        ("listed.io", "/p", None, "block"),
    ]
    listed = spark.createDataFrame([("http://m.listed.io/p#x",), (None,), ("bad",)], "url string")
    # One block: the filter lets everything through and the join alone decides.
    for blocks in (url_filter.BLOCKS, 1):
        found = url_filter.filter_urls(pages.withColumn("word", F.lit(1)), listed, rules, blocks=blocks)
        rows = sorted(found.collect())
        assert [(x.host, x.path, x.rule, x.verdict) for x in rows] == want
    assert not url_filter.filter_urls(pages.limit(0), listed, rules).collect()
    nothing = url_filter.filter_urls(pages, listed.limit(0), ())
    assert {x.verdict for x in nothing.collect()} == {"allow"}
