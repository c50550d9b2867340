"""Operators against golden rows, plain Python replays and properties."""

import datetime
import hashlib
import random
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.functions import net, text, urls
from folioscope.operators import changes, lifecycle, media, safety
from folioscope.operators import export as exporting
from folioscope.operators import query as reading
from folioscope.plans import snapshot_queries
from folioscope.schema import BOOKMARKS, LINKS, TAGS, Change
from folioscope.session import scratch_dir
from folioscope.sources import archive as storing
from folioscope.sources import captures as capturing
from folioscope.sources import snapshot as bucketing
from folioscope.streaming import admission
from folioscope.streaming import lifecycle as streaming
from folioscope.streaming import monitor

DAY = datetime.datetime(2024, 1, 1)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


# --- addresses ------------------------------------------------------------------------


def test_normal_form_of_addresses(spark):
    cases = {
        "\tHttps://Blatt.TEST:443/über/ñ?k=ż&l=1#oben ": "https://blatt.test/%C3%BCber/%C3%B1?k=%C5%BC&l=1",
        "http://a.b/x/../y/./z": "http://a.b/y/z",
        "http://0x7f.1/": "http://127.0.0.1/",
        "http://münchen.de/a b": "http://xn--mnchen-3ya.de/a%20b",
        "http://h:8080?a=b": "http://h:8080/?a=b",
        "": None,
        "普通文本": None,
        "file:///etc/passwd": None,
        "http://u:p@h/": None,
        "http://h:99999/": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r.u: r.normalized_url for r in urls.with_normalized_url(df, "u").collect()}
    assert got == cases
    again = spark.createDataFrame([(v,) for v in cases.values() if v], "u string")
    for r in urls.with_normalized_url(again, "u").collect():
        assert r.normalized_url == r.u


def test_an_address_has_a_normal_form_or_a_fault(spark):
    odd = ["http://", "http:///x", "http://h", "http://h?", "http://h/?", "http://h#", "http://h?#", "http://:80/", "http://h:/", "http://[::1]", "http://[::1", "http://a b/", "http://@h/", "http://:@h/", "http:h", "http:\\\\h\\p", "HTTP://%41/", "http://h/%", "http://h/\x00", "//h/", "x", None, "http://1.2.3.4.5/", "http://256.1.1.1/", "http://xn--/", "https://ü.ß/é?ä#ö"]
    df = spark.createDataFrame([(u,) for u in odd], "u string")
    both = df.select("u", urls.normalize_url(F.col("u")).alias("n"), urls.url_error(F.col("u")).alias("e")).collect()
    assert [r.u for r in both if (r.n is None) == (r.e is None)] == []


BLOCKED = "127.0.0.1 10.1.2.3 172.16.8.9 192.168.1.1 169.254.169.254 0.0.0.0 ::1 fc00::1 fe80::1%eth0 ::ffff:127.0.0.1 198.18.0.46 x 01.2.3.4"
OPEN = "93.184.216.34 2606:2800:220:1:248:1893:25c8:1946 172.32.0.1"


def test_blocked_addresses(spark):
    df = spark.createDataFrame([(a,) for a in (BLOCKED + " " + OPEN).split()], "address string")
    got = {r.address: r.b for r in df.select("address", net.blocked_ip(F.col("address")).alias("b")).collect()}
    assert got == {**{a: True for a in BLOCKED.split()}, **{a: False for a in OPEN.split()}}
    hits = {r.address for r in safety.cidr_join(df, safety.block_list(spark)).collect()}
    assert hits == set(BLOCKED.split()) - {"x", "01.2.3.4"}


def test_host_verdicts_by_any_and_all(spark):
    public, inner, fake = "93.184.216.34", "10.0.0.8", "198.18.0.46"
    dns = [("safe", public), ("mixed", public), ("mixed", inner), ("proxied", fake), ("trap", fake), ("odd", fake), ("odd", "192.168.1.8"), ("lost", fake)]
    trusted = [("proxied", public), ("trap", inner), ("odd", public)]
    hosts = spark.createDataFrame([(h,) for h in ("safe", "mixed", "proxied", "trap", "odd", "lost", "none", "localhost")], "host string")
    tables = [spark.createDataFrame(t, "host string, address string") for t in (dns, trusted)]
    got = {r.host: r.error_code for r in safety.host_verdict(hosts, *tables).collect()}
    private = "PRIVATE_NETWORK_BLOCKED"
    assert got == {
        "safe": None, "mixed": private, "proxied": None, "trap": private, "odd": private,
        "lost": "DNS_FAILED", "none": "DNS_FAILED", "localhost": private,
    }


# --- bytes -----------------------------------------------------------------------------


def test_decoding_by_header_meta_and_mark(spark):
    word = "中文内容"
    rows = [
        (1, f"<p>{word}</p>".encode("gbk"), "text/html; charset=GBK", f"<p>{word}</p>"),
        (2, f'<meta charset="gb2312"><p>{word}</p>'.encode("gb18030"), "text/html", f'<meta charset="gb2312"><p>{word}</p>'),
        (3, b"\xef\xbb\xbf" + word.encode(), "text/html; charset=gbk", word),
        (4, word.encode(), "text/html; charset=unheard-of", word),
        (5, b"ok \xff end", None, "ok � end"),
        (6, "日本".encode("cp932"), "text/html; charset='shift_jis'", "日本"),
    ]
    df = spark.createDataFrame(rows, "id int, body binary, content_type string, want string")
    for r in capturing.decode_captures(df).collect():
        assert r.html == r.want, r.id


# --- lifecycle -------------------------------------------------------------------------------


def replay(events, now, minutes):
    """The rules, one event after the other."""
    window, states, outcomes = datetime.timedelta(minutes=minutes), {}, []
    for key, kind, ts, event_id in sorted(events, key=lambda e: (e[0], e[2], e[3])):
        state, at = states.get(key, ("none", None))
        outcome = "applied"
        if kind == "create" and state != "live":
            if state == "deleted" and ts - at > window:
                outcomes.append((key, "purge", "purged"))
            state, at = "live", None
        elif kind == "delete" and state == "live":
            state, at = "deleted", ts
        elif kind == "restore" and state == "deleted" and ts - at <= window:
            state, at = "live", None
        else:
            outcome = "rejected"
            if state == "deleted" and ts - at > window:
                outcomes.append((key, "purge", "purged"))
                state, at = "none", None
        states[key] = (state, at)
        outcomes.append((key, kind, outcome))
    for key, (state, at) in states.items():
        if state == "deleted" and now - at > window:
            outcomes.append((key, "purge", "purged"))
            state = "none"
        states[key] = "purged" if state == "none" else state
    return states, sorted(outcomes)


def make_log(seed, n=1500):
    rng, at, rows = random.Random(seed), DAY, []
    for i in range(n):
        at += datetime.timedelta(seconds=rng.choice((0, 30, 200, 900)), microseconds=rng.randrange(3) * 500)
        key = "hot" if rng.random() < 0.4 else f"b{rng.randrange(25)}"
        rows.append((key, rng.choice(("create", "delete", "delete", "restore")), at, i))
    return rows, at


LOG = "key string, kind string, ts timestamp, event_id long"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_states_equal_a_replay_even_for_a_hot_key(spark, seed):
    rows, end = make_log(seed)
    now = end + datetime.timedelta(minutes=3)
    events = spark.createDataFrame(rows, LOG).repartition(6)
    got = lifecycle.current_state(events, F.lit(now), 10).collect()
    assert {r.key: r.state for r in got} == replay(rows, now, 10)[0]


def test_stream_equals_the_replay(spark, tmp_path):
    rows, end = make_log(5, 400)
    late = end + datetime.timedelta(days=2)  # lets the watermark pass all other events
    source = str(tmp_path / "log")
    half = len(rows) // 2
    shuffled = rows[:half]
    random.Random(1).shuffle(shuffled)
    for part in (shuffled, rows[half:], [("end", "create", late, 10**6)]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
    streaming.use_rocksdb(spark)
    stream = capturing.read_capture_stream(
        spark, source, spark.createDataFrame([], LOG).schema, maxFilesPerTrigger="1"
    )
    out = streaming.lifecycle_stream(stream, 10, "1 day")
    run = (
        out.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    run.awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
    want = replay(rows, late - datetime.timedelta(days=1), 10)[1]
    assert values(got, "key", "kind", "outcome") == want


def streamed(spark, tmp_path, batches, schema, work):
    """Rows that `work` gives for a stream of these batches, one file each."""
    source = str(tmp_path / "in")
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    streaming.use_rocksdb(spark)
    stream = capturing.read_capture_stream(
        spark, source, spark.createDataFrame([], schema).schema, maxFilesPerTrigger="1"
    )
    out = work(stream)
    run = (
        out.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def test_one_bookmark_with_very_many_events(spark, tmp_path):
    """Linear in the events: this takes minutes if each of them looks at all that wait."""
    draw, at, rows = random.Random(3), DAY, []
    for i in range(30_000):
        at += datetime.timedelta(milliseconds=draw.choice((0, 40, 2000, 900_000)))
        rows.append(("hot", draw.choice(("create", "delete", "restore")), at, i))
    late = at + datetime.timedelta(days=2)
    batches = (rows[:15_000], rows[15_000:], [("end", "create", late, 10**6)])
    got = streamed(
        spark, tmp_path, batches, LOG, lambda s: streaming.lifecycle_stream(s, 10, "1 day")
    )
    assert values(got, "key", "kind", "outcome") == replay(rows, late - datetime.timedelta(days=1), 10)[1]


def test_streamed_admission_against_the_stored_urls(spark, tmp_path):
    stored = spark.createDataFrame(
        [("b1", "https://s.example/1", None), ("b2", "https://s.example/2", DAY), ("b3", "https://s.example/3", DAY),
         ("b4", "https://s.example/3", None)],
        "id string, normalized_url string, deleted_at timestamp",
    )
    minute = lambda k: DAY + datetime.timedelta(minutes=k)
    batches = (
        [("r3", minute(3), "https://s.example/2#x"), ("r1", minute(1), "HTTPS://s.example/1"), ("r2", minute(2), "https://s.example/2"),
         ("r4", minute(9), "https://s.example/9"), ("r5", minute(9), "nonsense")],
        [("q1", minute(0), "https://s.example/9"), ("q2", minute(0), "https://s.example/3"), ("q3", minute(0), "https://s.example/2"), ("q4", minute(0), "nonsense")],
        [("p1", DAY + datetime.timedelta(days=900), "https://s.example/1"), ("p2", minute(1), "https://s.example/8"), ("p3", minute(1), "https://s.example/8")],
    )
    schema = "request_id string, ts timestamp, url string"
    got = streamed(spark, tmp_path, batches, schema, lambda s: admission.admission_verdicts(s, stored))
    assert {r.request_id: (r.outcome, r.replaced_id) for r in got.collect()} == {
        "r1": ("DUPLICATE_URL", None), "r2": ("admitted", "b2"), "r3": ("DUPLICATE_URL", None), "r4": ("admitted", None), "r5": ("INVALID_URL", None),
        "q1": ("DUPLICATE_URL", None), "q2": ("DUPLICATE_URL", None), "q3": ("DUPLICATE_URL", None), "q4": ("INVALID_URL", None),
        "p1": ("DUPLICATE_URL", None), "p2": ("admitted", None), "p3": ("DUPLICATE_URL", None),
    }
    assert got.count() == 12


def test_state_calls_of_a_key_do_not_grow_with_its_events():
    calls = []

    class State:
        def __init__(self, name, schema):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows) if isinstance(self.rows, list) else self.rows
        clear = lambda self: calls.append("clear") or self.rows.clear()
        appendValue = lambda self, row: calls.append("append") or self.rows.append(row)

        def update(self, row):
            self.rows = row

    class Handle:
        getValueState = getListState = lambda self, name, schema: State(name, schema)
        registerTimer = lambda self, ms: calls.append(ms)

    class Timers:
        getCurrentWatermarkInMs = lambda self: 1_000_700

    job = streaming.Lifecycle(10)
    job.init(Handle())
    frame = pd.DataFrame({"ts": pd.to_datetime([1000 + i for i in range(900, -1, -1)], unit="s"), "event_id": range(901), "kind": ["create"] * 901})
    list(job.handleInputRows(("k",), iter([frame]), Timers()))
    assert calls == ["append", 1_000_000]
    out = pd.concat(job.handleExpiredTimer(("k",), Timers(), None))
    assert out["outcome"].tolist() == ["applied"] and out["event_id"].tolist() == [900]
    assert calls[2:] == ["clear", "append", 1_001_000]
    assert list(job.handleExpiredTimer(("k",), Timers(), None)) == []


def test_sessions_of_a_table(spark):
    draw, rows = random.Random(7), []
    for key in ("a", "b", "c"):
        at = DAY
        for _ in range(200):
            at += datetime.timedelta(seconds=draw.choice((0, 1, 1799, 1800, 1801, 7200)))
            rows.append((key, at))
    rows.append((None, DAY))
    gap, want = datetime.timedelta(minutes=30), []
    for key, at in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if want and want[-1][0] == key and at < want[-1][2]:
            want[-1][2:] = [at + gap, want[-1][3] + 1]
        else:
            want.append([key, at, at + gap, 1])
    got = monitor.status_sessions(spark.createDataFrame(rows, "key string, ts timestamp").repartition(5))
    assert sorted(map(list, got.collect()), key=str) == sorted(want, key=str)


def test_static_and_streamed_admission_agree(spark, tmp_path):
    rows = [(DAY + datetime.timedelta(minutes=i), f"HTTP://Site.example/{i % 7}#{i}") for i in range(40)]
    df = spark.createDataFrame([*rows, (DAY, "nonsense")], "ts timestamp, url string")
    df.write.parquet(str(tmp_path / "in"))
    stream = capturing.read_capture_stream(spark, str(tmp_path / "in"), df.schema)
    run = (
        monitor.admit_stream(stream).writeStream.format("memory").queryName("admitted")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    seen = values(spark.table("admitted"), "normalized_url")
    assert seen == values(monitor.admit_stream(df), "normalized_url") and len(seen) == 7
    assert [r.error_code for r in monitor.rejected_urls(df).collect()] == ["INVALID_URL"]


# --- archive ------------------------------------------------------------------------------------


def small_archive(spark):
    rows = [
        ("b1", "https://a.example/1", "Alpha 100%", "body one"),
        ("b2", "https://b.example/2", "beta_x", "zweiter ÄPFEL text"),
    ]
    bookmarks = spark.createDataFrame(rows, "id string, url string, title string, markdown_content string").withColumns(
        {
            "normalized_url": F.col("url"), "final_url": F.col("url"), "domain": F.substring("url", 9, 9),
            "created_at": F.lit(DAY), "updated_at": F.lit(DAY),
        }
    )
    tags = spark.createDataFrame([("t1", "Work", "work"), ("t2", "Home", "home"), ("t3", "Idle", "idle")], "id string, name string, normalized_name string")
    links = spark.createDataFrame([("b1", "t1"), ("b2", "t1"), ("b2", "t2")], "bookmark_id string, tag_id string")
    return storing.make_archive(bookmarks, tags, links)


def test_snapshot_in_buckets(spark, tmp_path):
    a, root = small_archive(spark), str(tmp_path / "stored")
    bucketing.write_snapshot(a, root, 4)
    stored = bucketing.open_snapshot(spark, root)
    for q in ("ALPHA", "100%", "a_x", "home", "zweiter", "b.example/2", "ÄPFEL", "äpfel", "be", "x", "nothing at all", " "):
        assert values(stored.search(q), "id") == values(reading.search(a, q), "id"), q
    assert values(stored.lookup(["b2", "b9"]), "id") == [("b2",)]
    listed = reading.list_bookmarks(a, sort="title")[0]
    assert values(stored.list_page(sort="title"), "id") == values(listed, "id")
    assert stored.list_page(q="nothing at all").isEmpty()

    # The only bookmark of a bucket goes, another bucket is left as it is.
    files = lambda: {r.id: r.f for r in stored.table("bookmarks").select("id", F.col("_metadata.file_name").alias("f")).collect()}
    before, gone = files(), spark.createDataFrame([("b1",)], "bookmark_id string")
    purge = lambda part: changes.purge(changes.soft_delete(part, gone, F.lit(DAY)).archive, F.lit(DAY + datetime.timedelta(days=1)))
    change = stored.update(gone, purge, ("bookmarks", "links"))
    assert values(change.removed, "id") == [("b1",)]
    assert files() == {"b2": before["b2"]} and stored.search("ALPHA").isEmpty()
    assert values(stored.archive().links, "bookmark_id", "tag_id") == [("b2", "t1"), ("b2", "t2")]
    assert changes.audit(stored.archive()).isEmpty()


def test_a_large_bucket_is_dealt_to_several_tasks(spark, tmp_path):
    a, draw = small_archive(spark), random.Random(3)
    body = lambda i: f"Row {i:03} 😀" + "".join(draw.choice("abcd éÄ") for _ in range(3000))
    rows = spark.createDataFrame([(f"x{i}", body(i)) for i in range(400)], "id string, markdown_content string").repartition(8)
    full = storing.make_archive(a.bookmarks.unionByName(rows, allowMissingColumns=True), a.tags, a.links)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "100k")
    try:
        stored = bucketing.write_snapshot(full, str(tmp_path / "stored"), 1)
    finally:
        spark.conf.unset(size)
    assert len(set(stored.table("bookmarks").inputFiles())) > 2
    for q in ("ROW 01", "😀", "é", "ab", "dÄb", "home", "row 399 😀"):
        found = values(stored.search(q), "id")
        assert found == values(reading.search(full, q), "id") and found, q


def folder_bytes(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def shuffle_bytes(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [found.apply(i) for i in range(found.size())]
    return sum(f.length() for f in files if f.getName().startswith("shuffle"))


def test_a_rewrite_keeps_old_files_until_it_is_whole_and_leaves_no_copies(spark, tmp_path):
    a, root, draw = small_archive(spark), tmp_path / "stored", random.Random(5)
    bodies = [(f"x{i}", f"Row {i}", "".join(draw.choice("abcdefgh ") for _ in range(10_000))) for i in range(300)]
    rows = spark.createDataFrame(bodies, "id string, title string, markdown_content string").repartition(4)
    full = storing.make_archive(a.bookmarks.unionByName(rows, allowMissingColumns=True), a.tags, a.links)
    none = F.lit(None).cast("string")
    patches = spark.createDataFrame([(f"x{i}", f"New {i}") for i in [*range(0, 300, 10), 999]], "bookmark_id string, title string")
    patches = patches.select("*", none.alias("user_note"), none.alias("markdown_content"))
    shared, shuffled = spark.conf.get("spark.checkpoint.dir"), shuffle_bytes(spark)
    stored = bucketing.write_snapshot(full, str(root), 10)
    size, kept = folder_bytes(root / "bookmarks"), folder_bytes(shared)
    assert size < 2_500_000  # 3 MB of texts, of 4 bits a character
    files = lambda: {r.id: r.f for r in stored.table("bookmarks").select("id", F.col("_metadata.file_name").alias("f")).collect()}
    before = files()

    def broken(part):
        change = changes.edit(part, patches, F.lit(DAY))
        fault = F.when(F.col("id") == "x290", F.raise_error(F.lit("fault"))).otherwise(F.col("url"))
        return Change(change.archive.replace(bookmarks=change.archive.bookmarks.withColumn("url", fault)), change.applied, change.rejects)

    with pytest.raises(Exception, match="fault"):
        stored.update(patches, broken, ("bookmarks",))
    assert files() == before and stored.search("New 29").isEmpty()

    change = stored.update(patches, lambda part: changes.edit(part, patches, F.lit(DAY)), ("bookmarks", "links"))
    for _ in range(20):  # shuffle files go in the background
        if shuffle_bytes(spark) - shuffled >= 0.5 * size:
            time.sleep(0.5)
    assert shuffle_bytes(spark) - shuffled < 0.5 * size
    # Of texts, the tables have one copy, and nothing else more than the few changed rows.
    assert folder_bytes(root / "bookmarks") < 1.2 * size and folder_bytes(root / "_draft") == 0
    assert folder_bytes(shared) - kept < 0.5 * size

    wanted, columns = changes.edit(full, patches, F.lit(DAY)), ("id", "title", "url", "markdown_content", "plain_text")
    assert values(stored.archive().bookmarks.na.fill("-"), *columns) == values(wanted.archive.bookmarks.na.fill("-"), *columns)
    assert values(stored.archive().links, "bookmark_id", "tag_id") == values(full.links, "bookmark_id", "tag_id")
    assert values(change.applied, *columns) == values(wanted.applied, *columns)
    assert values(change.rejects) == [("x999", "NOT_FOUND")]
    hit = {r.b for r in patches.select(bucketing.bucket_of(F.col("bookmark_id"), 10).alias("b")).collect()}
    now = stored.table("bookmarks").select("id", "bucket", F.col("_metadata.file_name").alias("f")).collect()
    assert len(hit) > bucketing.PARTS and all((r.f != before[r.id]) == (r.bucket in hit) for r in now)
    assert values(change.archive.bookmarks, "id") == sorted((r.id,) for r in now if r.bucket in hit)
    assert values(stored.search("nEW 2"), "id") == values(reading.search(wanted.archive, "nEW 2"), "id") != []


def test_partial_snapshot_leaves_less_than_four_times_its_input(spark, tmp_path):
    draw = random.Random(8)
    texts = [(i, "".join(draw.choice("abcdefgh ") for _ in range(20_000)), "de", "web", 20_000) for i in range(200)]
    tables = {
        "documents": spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long"),
        "pages": spark.createDataFrame([(1, "https://a.example/1", "<p>x</p>")], "page_id long, url string, html string"),
        "labels": spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int"),
        "events": spark.range(1),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    size, shared = folder_bytes(tmp_path), spark.conf.get("spark.checkpoint.dir")
    before = folder_bytes(shared) + shuffle_bytes(spark)
    rows = snapshot_queries.partial_snapshot(spark, str(tmp_path)).collect()
    for _ in range(20):  # shuffle files go in the background
        if (left := folder_bytes(shared) + shuffle_bytes(spark) - before) >= 4 * size:
            time.sleep(0.5)
    assert left < 4 * size
    assert {r.title for r in rows if int(r.id) % 90 == 2} == {"Edited de"} and len(rows) == 200
    hit = {int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 16 for i in range(2, 200, 90)}
    assert all(r.rewritten == (int(hashlib.md5(r.id.encode()).hexdigest()[:8], 16) % 16 in hit) for r in rows)
    assert not any(r.links_rewritten for r in rows)


def test_search_covers_fields_and_tags(spark):
    a = small_archive(spark)
    for q, want in {"ALPHA": "b1", "100%": "b1", "a_x": "b2", "home": "b2", "zweiter": "b2", "b.example/2": "b2"}.items():
        assert [r.id for r in reading.search(a, q).collect()] == [want], q
    assert reading.search(a, "äpfel").isEmpty()  # only ASCII case is folded
    assert reading.search(a, "  ").count() == 2


def test_suggestions_for_a_bookmark_with_many_tags(spark):
    a = small_archive(spark)
    names = [(f"n{i:02}", f"Name {i:02}", f"name {i:02}") for i in range(30)]
    tags = spark.createDataFrame(names, "id string, name string, normalized_name string")
    links = spark.createDataFrame([("b1", f"n{i:02}") for i in range(18)], "bookmark_id string, tag_id string")
    full = storing.make_archive(a.bookmarks, tags, links)
    found = reading.suggest_tags(full, full.bookmarks.select("id")).collect()
    of = lambda b: [x.tag_id for x in sorted(found, key=lambda x: x.position) if x.bookmark_id == b]
    assert of("b1") == [f"n{i}" for i in range(18, 24)]
    assert of("b2") == [f"n{i:02}" for i in range(6)]


def test_tags_of_a_missing_bookmark_are_refused(spark):
    a = small_archive(spark)
    asked = spark.createDataFrame([("b1", ["Home"]), ("gone", ["New"])], "bookmark_id string, tag_names array<string>")
    change = changes.set_tags(a, asked, F.lit(DAY))
    assert values(change.archive.links, "bookmark_id", "tag_id") == [("b1", "t2"), ("b2", "t1"), ("b2", "t2")]
    assert change.archive.tags.count() == 3
    assert [tuple(r)[:2] for r in change.rejects.collect()] == [("gone", "NOT_FOUND")]


PATCH = "seq int, bookmark_id string, title string, user_note string, markdown_content string"


def test_patches_of_one_bookmark_apply_in_order(spark):
    a = small_archive(spark)
    rows = [
        (2, "b1", "Second", None, "body one"), (1, "b1", "First", "note", "other"), (3, "b1", None, None, None),
        (1, "b2", None, "kept", "zweiter ÄPFEL text"), (1, "gone", "x", None, None), (9, "b2", " ", None, None),
    ]
    patches = spark.createDataFrame(rows, PATCH)
    change = changes.edit(a, patches, F.lit(DAY))
    got = values(change.archive.bookmarks, "id", "title", "user_note", "markdown_content", "is_content_edited")
    assert got == [
        ("b1", "Second", "note", "body one", True),
        ("b2", "beta_x", "kept", "zweiter ÄPFEL text", False),
    ]
    assert values(change.rejects) == [("b2", "VALIDATION_ERROR"), ("gone", "NOT_FOUND")]
    unordered = changes.edit(a, patches.where("seq < 3").drop("seq"), F.lit(DAY))
    assert values(unordered.archive.bookmarks, "id", "title") == [("b1", "Alpha 100%"), ("b2", "beta_x")]
    assert values(unordered.rejects) == [("b1", "VALIDATION_ERROR"), ("gone", "NOT_FOUND")]
    assert changes.audit(change.archive).isEmpty() and changes.audit(unordered.archive).isEmpty()


def test_the_newest_result_of_a_bookmark_counts(spark):
    a = small_archive(spark)
    pending = storing.make_archive(a.bookmarks.withColumn("extraction_status", F.lit("pending")), a.tags, a.links)
    results = spark.createDataFrame(
        [(n, "b1", f"T{n}", "success", f"text {n}", True) for n in (1, 3, 2)],
        "seq int, bookmark_id string, title string, extraction_status string, markdown_content string, overwrite boolean",
    ).withColumns({c: F.lit("https://a.example/1") for c in ("final_url", "domain")})
    change = changes.apply_extractions(pending, results, F.lit(DAY))
    assert values(change.archive.bookmarks, "id", "title") == [("b1", "T3"), ("b2", "beta_x")]
    assert values(change.rejects) == [("b1", "SUPERSEDED")]
    assert changes.audit(change.archive).isEmpty()


def test_renames_that_are_allowed_win(spark):
    a = small_archive(spark)
    asked = [("t1", "home"), ("t2", "HOME"), ("t0", "fresh"), ("t3", "Fresh"), ("t1", "home")]
    renames = spark.createDataFrame(asked[:4], "tag_id string, name string")
    change = changes.rename_tags(a, renames, F.lit(DAY))
    assert values(change.archive.tags, "id", "name") == [("t1", "Work"), ("t2", "HOME"), ("t3", "Fresh")]
    assert values(change.rejects) == [("t0", "NOT_FOUND"), ("t1", "VALIDATION_ERROR")]
    twice = changes.rename_tags(a, spark.createDataFrame(asked, renames.schema), F.lit(DAY))
    assert values(twice.archive.tags, "id", "name") == values(change.archive.tags, "id", "name")
    assert changes.audit(change.archive).isEmpty()


def test_renames_in_turn_equal_a_replay(spark):
    """One rename after the other, as if each was asked for alone."""
    names = [f"n{i}" for i in range(30)]
    tags = spark.createDataFrame([(f"t{i}", n.upper(), n) for i, n in enumerate(names[:20])], "id string, name string, normalized_name string")
    a = small_archive(spark)
    a = storing.make_archive(a.bookmarks, tags, a.links.limit(0))
    for seed in range(3):
        draw = random.Random(seed)
        asked = [(f"t{i}", draw.choice(names[: 8 + 8 * seed]), draw.randrange(1000) * 100 + i) for i in range(20)]
        held, refused = {f"t{i}": n for i, n in enumerate(names[:20])}, set()
        for tag, name, _ in sorted(asked, key=lambda r: r[2]):
            if any(n == name and t != tag for t, n in held.items()):
                refused.add((tag, "VALIDATION_ERROR"))
            else:
                held[tag] = name
        change = changes.rename_tags(a, spark.createDataFrame(asked, "tag_id string, name string, seq int"), F.lit(DAY))
        assert values(change.archive.tags, "id", "normalized_name") == sorted(held.items())
        assert values(change.rejects) == sorted(refused)


def test_edits_meet_the_bookmarks_once(spark):
    a = small_archive(spark)
    patches = spark.createDataFrame([("b1", "New", None, None)], "bookmark_id string, title string, user_note string, markdown_content string")
    after = changes.edit(a, patches, F.lit(DAY)).archive.bookmarks
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert values(after, "id", "title") == [("b1", "New"), ("b2", "beta_x")]


def test_ids_of_admitted_requests_are_unique(spark):
    rows = [("n1", 2, "https://n.example/2", []), ("n1", 1, "https://n.example/1", ["a"]), ("b1", 3, "https://n.example/3", []), (None, 4, "https://n.example/4", [])]
    requests = spark.createDataFrame(rows, "request_id string, seq int, url string, tag_names array<string>")
    change = changes.admit(small_archive(spark), requests, F.lit(DAY))
    found = values(change.archive.bookmarks, "id", "normalized_url")
    assert found == [("b1", "https://a.example/1"), ("b2", "https://b.example/2"), ("n1", "https://n.example/1")]
    assert sorted(map(tuple, change.rejects.collect()), key=str) == [("b1", "VALIDATION_ERROR"), ("n1", "VALIDATION_ERROR"), (None, "VALIDATION_ERROR")]
    assert changes.audit(change.archive).isEmpty()


def test_admission_to_addresses_stored_twice(spark):
    a = small_archive(spark)
    gone = a.bookmarks.withColumns({"id": F.concat("id", F.lit("x")), "deleted_at": F.lit(DAY)})
    twice = gone.unionByName(gone.withColumn("id", F.concat("id", F.lit("y")))).unionByName(a.bookmarks.where("id = 'b1'"))
    requests = spark.createDataFrame([("n1", 1, "https://a.example/1", []), ("n2", 2, "https://b.example/2", [])], "request_id string, seq int, url string, tag_names array<string>")
    change = changes.admit(a.replace(bookmarks=twice), requests, F.lit(DAY))
    assert values(change.archive.bookmarks, "id") == [("b1",), ("b1x",), ("b1xy",), ("n2",)]
    assert values(change.removed) == [("b2x",), ("b2xy",)] and values(change.rejects) == [("n1", "DUPLICATE_URL")]


def test_admission_refuses_what_is_over_the_limits(spark):
    rows = [("n1", 1, "https://n.example/" + "x" * 4000, []), ("n2", 2, "https://n.example/2", [f"t{i}" for i in range(13)]), ("n3", 3, "https://n.example/2", ["a"])]
    requests = spark.createDataFrame(rows, "request_id string, seq int, url string, tag_names array<string>")
    change = changes.admit(small_archive(spark), requests, F.lit(DAY))
    assert values(change.archive.bookmarks, "id") == [("b1",), ("b2",), ("n3",)]
    assert values(change.rejects) == [("n1", "VALIDATION_ERROR"), ("n2", "VALIDATION_ERROR")]


def test_files_of_removed_bookmarks_are_named(spark):
    deleted = changes.soft_delete(small_archive(spark), spark.createDataFrame([("b1",)], "bookmark_id string"), F.lit(DAY)).archive
    manifest = spark.createDataFrame([("b1", "a.png"), ("b2", "b.png")], "bookmark_id string, filename string")
    request = spark.createDataFrame([("n1", 1, "https://a.example/1", [])], "request_id string, seq int, url string, tag_names array<string>")
    for change in (
        changes.purge(deleted, F.lit(DAY + datetime.timedelta(days=1))),
        changes.admit(deleted, request, F.lit(DAY)),
    ):
        assert values(media.assets_to_remove(manifest, change.removed)) == [("b1", "a.png")]


def test_pages_join_to_the_full_list(spark):
    rows = [(f"{i:03}", DAY + datetime.timedelta(minutes=i // 2)) for i in range(55)]
    df = spark.createDataFrame(rows, "id string, created_at timestamp")
    pages = [[r.id for r in reading.page(df, n, 20).collect()] for n in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [20, 20, 15, 0]
    assert sum(pages, []) == [r.id for r in reading.sort_bookmarks(df).collect()]
    assert reading.page_bounds(0, 1000) == (0, 100)
    last = reading.page(df, 1, 20).collect()[-1]
    following = reading.next_page(df, {"created_at": last.created_at, "id": last.id}, 20)
    assert [r.id for r in following.collect()] == pages[1]


def test_snapshots_round_trip(spark, tmp_path):
    a, root = small_archive(spark), str(tmp_path / "archive")
    storing.write_archive(a, root)
    first = storing.read_archive(spark, root)
    assert first.bookmarks.schema.names == BOOKMARKS.names and first.tags.schema.names == TAGS.names
    ids = spark.createDataFrame([("b2",), ("zz",)], "bookmark_id string")
    change = changes.soft_delete(first, ids, F.lit(DAY))
    assert [(r.key, r.error_code) for r in change.rejects.collect()] == [("zz", "NOT_FOUND")]
    storing.write_archive(change.archive, root)
    second = storing.read_archive(spark, root)
    assert values(reading.live(second.bookmarks), "id") == [("b1",)]
    assert values(second.links, "bookmark_id", "tag_id") == values(first.links, "bookmark_id", "tag_id")
    purged = changes.purge(second, F.lit(DAY + datetime.timedelta(minutes=11)))
    assert values(purged.archive.links.select(*LINKS.names[:2])) == [("b1", "t1")]
    kept = changes.purge(second, F.lit(DAY + datetime.timedelta(minutes=10)))
    assert kept.archive.bookmarks.count() == 2


def test_readmission_of_a_deleted_address(spark):
    a = changes.soft_delete(small_archive(spark), spark.createDataFrame([("b1",)], "bookmark_id string"), F.lit(DAY)).archive
    requests = spark.createDataFrame(
        [("n1", 1, "https://A.example/1#x", ["Work", " new  Tag"]), ("n2", 2, "https://b.example/2", []), ("n3", 3, "https://a.example/1", [])],
        "request_id string, seq int, url string, tag_names array<string>",
    )
    change = changes.admit(a, requests, F.lit(DAY))
    assert values(change.archive.bookmarks, "id") == [("b2",), ("n1",)]
    assert values(change.rejects) == [("n2", "DUPLICATE_URL"), ("n3", "DUPLICATE_URL")]
    names = reading.attach_tags(change.archive.bookmarks, change.archive).where("id = 'n1'").first().tags
    assert sorted(t.name for t in names) == ["Work", "new Tag"]
    assert changes.audit(change.archive).isEmpty()


def test_curated_set_is_idempotent_and_guarded(spark):
    a = small_archive(spark)
    rows = spark.createDataFrame(
        [("c1", "https://c.example/", "C", "c.example", "# c", ["Work", "Cur"], DAY, DAY)],
        "id string, url string, title string, domain string, markdown_content string, tag_names array<string>, created_at timestamp, updated_at timestamp",
    )
    tags = spark.createDataFrame([("cw", "Work", "work"), ("cc", "Cur", "cur")], "id string, name string, normalized_name string")
    once = changes.upsert_curated(a, rows, tags, F.lit(DAY)).archive
    twice = changes.upsert_curated(once, rows, tags, F.lit(DAY)).archive
    assert values(once.links.select("bookmark_id", "tag_id")) == values(twice.links.select("bookmark_id", "tag_id"))
    assert twice.bookmarks.count() == 3 and changes.audit(twice).isEmpty()
    back = changes.remove_curated(twice, rows, tags.where("id = 'cc'"))
    assert values(back.archive.bookmarks, "id") == [("b1",), ("b2",)]
    assert "cc" not in {r.id for r in back.archive.tags.collect()}
    for taken in (rows.withColumn("id", F.lit("b1")), rows.withColumn("url", F.lit("https://a.example/1"))):
        with pytest.raises(changes.CuratedConflict):
            changes.upsert_curated(a, taken, tags, F.lit(DAY))


def test_tag_identity_is_unicode_aware(spark):
    df = spark.createDataFrame([("ＡＢＣ  x",), ("abc X",), ("Straße",)], "n string")
    got = [r[0] for r in df.select(text.normalize_tag_name(F.col("n"))).collect()]
    assert got == ["abc x", "abc x", "straße"]
    rows = spark.createDataFrame([("b", ["ＡＢＣ", "abc", " "])], "bookmark_id string, tag_names array<string>")
    assert values(changes.distinct_tag_names(rows)) == [("b", 0, "abc", "abc")]


# --- media and export -----------------------------------------------------------------------------


def test_images_are_localised_within_the_budget(spark):
    png = bytes.fromhex("89504E470D0A1A0A")
    md = "![a](https://c.example/1.png)\n![b](<https://c.example/d(large).png>)\n![a2](https://c.example/1.png)\n![gone](https://c.example/2.png)"
    bookmarks = spark.createDataFrame([("b1", md, "https://c.example/cover.png")], "id string, markdown_content string, cover_image_url string")
    found = [(f"https://c.example/{n}", png, "image/png", None) for n in ("1.png", "d(large).png", "cover.png")]
    downloads = spark.createDataFrame([*found, ("https://c.example/2.png", None, None, "HTTP_NOT_FOUND")], "url string, body binary, content_type string, error_code string")
    row = media.localize_images(bookmarks, downloads).first()
    assert (row.localized, row.failed, row.total_bytes) == (3, 1, 24)
    assert row.cover_image_url.startswith("/api/bookmarks/b1/assets/")
    assert row.markdown_content.count("/api/bookmarks/b1/assets/") == 3
    assert "https://c.example/2.png" in row.markdown_content and "large" not in row.markdown_content


def test_budget_lets_smaller_images_follow_a_refused_one(spark):
    rows = [("b", i, n) for i, n in enumerate((40, 30, 50, 20, 10, 1))]
    df = spark.createDataFrame(rows, "bookmark_id string, position int, bytes long")
    admitted = [r.position for r in media.byte_budget(df, 100).where("admitted").collect()]
    assert sorted(admitted) == [0, 1, 3, 4]


def test_export_sink_and_file_listing(spark, tmp_path):
    a = small_archive(spark)
    exported = exporting.export_markdown(a)
    first = exported.where("id = 'b2'").first()
    assert first.filename == "beta_x.md"
    assert first.content.startswith('---\ntitle: "beta_x"\nsource: "https://b.example/2"')
    assert '\ntags:\n  - "Work"\n  - "Home"\n---\n# beta_x\n\n' in first.content
    exporting.write_export_lines(exported, str(tmp_path / "export"))
    assert spark.read.text(str(tmp_path / "export")).count() == 2
    name = "0" * 24 + ".png"
    for file in (name, "notes.txt"):
        target = tmp_path / "assets" / "b1"
        target.mkdir(parents=True, exist_ok=True)
        (target / file).write_bytes(b"12345")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "assets"))
    listed = values(media.asset_manifest(files), "bookmark_id", "filename", "bytes", "content_type")
    assert listed == [("b1", name, 5, "image/png")]
    assert media.storage_usage(files).first().total_bytes == 10


def test_scratch_folder_is_the_shared_one(spark):
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
