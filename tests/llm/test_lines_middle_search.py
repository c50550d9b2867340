"""Line dedup, fill-in-the-middle and ranked search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import fill_middle, lexical_search, line_dedup
from folioscope.llm.shared import scratch_folder, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
#: Names that the operators use inside; documents may have such columns too.
CLASHES = ("lines", "line", "pos", "version", "dropped", "low", "id", "of", "keeper", "key")
CLASHES += ("h1", "n", "form", "output", "m", "term", "terms", "tf", "segment", "score", "rank")
LOWER = {c: c + 32 for c in range(65, 91)}
BLANKS = " \t\n\x0b\x0c\r"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def frame(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


def pairs(docs):
    return [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]


# Lines


def plain_lines(rows, rules):
    """[(id, n_lines, n_dropped, text)], one for one."""
    holders = defaultdict(set)

    def key(line):
        return line.strip(BLANKS).translate(LOWER)

    for id_, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= rules.min_chars and id_ is not None:
                holders[key(line)].add(id_)
    gone = {k: max(ids) for k, ids in holders.items() if len(ids) >= rules.min_documents}
    out = []
    for id_, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == id_]
        out.append((id_, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    draw = random.Random(4)
    stock = [f"{'long line ' * 3}{i}" for i in range(12)] + ["short", "", "  ", "É" * 19, "É" * 20]

    def styled(line):
        return draw.choice(["{}", " {}\t", "\x0b{}\r", "{}  "]).format(
            line.upper() if draw.random() < 0.3 and line.isascii() else line
        )

    rows = [
        (i, "\n".join(styled(draw.choice(stock)) for _ in range(draw.randint(1, 12))))
        for i in range(40)
    ]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "é" * 20), (104, "É" * 20)]
    rows += [(105, "x" * 20 + " "), (106, "x" * 20), (107, "x" * 20)]
    rows += [(5, rows[5][1]), (6, "another text\n" + stock[0]), (None, stock[1]), (None, stock[1])]
    rows += [(200 + i, "only " * 5) for i in range(3)] + [(300, "own " * 9)]
    return rows + [(301, "\n".join(f"{'w ' * 12}{i % 50}" for i in range(20_000)))]


@pytest.mark.parametrize("rules", [line_dedup.LineRules(), line_dedup.LineRules(5, 2)])
def test_lines(spark, rules):
    rows = line_rows()
    found = line_dedup.drop_common_lines(frame(spark, rows), rules).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(plain_lines(rows, rules), key=repr)


def test_lines_of_the_given_and_of_no_documents(spark):
    docs, rules = table(spark, SF, "documents"), line_dedup.LineRules()
    found = line_dedup.drop_common_lines(docs, rules).collect()
    assert sorted(map(tuple, found)) == sorted(plain_lines(pairs(docs), rules))
    assert sum(x.n_dropped for x in found)
    assert line_dedup.drop_common_lines(docs.limit(0)).collect() == []


def test_lines_without_python(spark):
    """The main path has no Python worker."""
    plan = line_dedup.drop_common_lines(table(spark, SF, "documents"))
    assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().toString())


# Middle


def plain_middle(id_, text):
    """(n, form, prefix, middle, output)."""
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    a, b, share, turn = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not n or re.search("<[PSM]>", text) or share % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    pre, mid, suf = text[:low], text[low:high], text[high:]
    if turn % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", low, high - low, f"<P>{pre}<S>{suf}<M>{mid}"


def middle_rows():
    draw = random.Random(5)
    letters = "ab <>PSMé日🙂́\n"
    rows = [
        (i, "".join(draw.choice(letters) for _ in range(draw.randint(0, 12)))) for i in range(600)
    ]
    rows += [(1000 + i, x) for i, x in enumerate(["<", "<P", "P>", "<S>", "S><", "<<M", "🙂"] * 9)]
    rows += [(2000, None), (2001, ""), (None, "no id"), (None, None), (7, rows[7][1])]
    return rows + [(3000, "é🙂 long " * 200_000), (-1, "negative"), (2**62, "large")]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_middle(spark):
    rows = middle_rows()
    made = fill_middle.fill_in_middle(frame(spark, rows)).cache()
    want = []
    for id_, text in rows:
        *counts, output = plain_middle(id_, text)
        want.append((id_, *counts, output, digest(output)))
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}

    back = fill_middle.restore(made.withColumn("text", F.lit("clash"))).collect()
    texts = sorted((x.doc_id, x.text, x.restored_sha256) for x in back if x.doc_id is not None)
    assert texts == sorted((i, t or "", digest(t or "")) for i, t in rows if i is not None)
    assert sorted(x.text for x in back if x.doc_id is None) == ["", "no id"]
    made.unpersist()


def test_middle_of_other_shares_and_of_no_documents(spark):
    docs = table(spark, SF, "documents")
    for mix, forms in ((fill_middle.Mix(0), {"plain"}), (fill_middle.Mix(100, 100), {"spm"})):
        made = fill_middle.fill_in_middle(docs.where("text <> ''"), mix)
        assert {x.form for x in made.select("form").distinct().collect()} == forms
    assert fill_middle.restore(fill_middle.fill_in_middle(docs.limit(0))).collect() == []


def test_descriptors():
    raw = memoryview(b"abcdef")
    cut = fill_middle.of_text(raw).cut(2, 2)
    assert cut.parts == [(0, 0, 2), (0, 2, 2), (0, 2, 6)]
    assert cut.cut(1, 6).join() == b"abcdef"
    for form in fill_middle.ARRANGEMENTS:
        output = fill_middle.arranged(cut, form)
        assert fill_middle.restored(memoryview(output.join()), form).join() == b"abcdef"


# Search


def plain_search(rows, items, top):
    """{(item, rank): (id, score)} over (id, text) rows; items by id."""
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    terms = defaultdict(set)
    for item, text in items:
        terms[item].update(TERM.findall((text or "").translate(LOWER)))
    out = {}
    for item, wanted in terms.items():
        scored = []
        for id_, counts in docs:
            m = 50 + 50 * counts.total() * n_docs // n_terms
            score = 0
            for t in wanted & counts.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                scored.append((-score, id_ is None, id_ or 0, id_))
        for rank, (score, _, _, id_) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1):
            out[item, rank] = (id_, -score)
    return out


def search_rows():
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é", "日本", "x²"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]

    def text(longest):
        return " ".join(draw.choices(vocabulary, weights, k=draw.randint(1, longest)))

    rows = [(i, text(40)) for i in range(400)]
    # Copies with equal scores, rows without id or text, repeated rows.
    rows += [(1000 - i, "W1 w2, w3; W4-w5") for i in range(80)]
    rows += [(2000, None), (2001, ""), (2002, " .,-"), (None, "w1 w2"), (None, "w29")]
    rows += [(3, rows[3][1]), (4, "w7 w8 w9"), (2003, "w28 " * 30_000)]
    items = [(i, text(12)) for i in range(30)]
    items += [(50, None), (51, ""), (52, "unheard of"), (53, "w1 W2 w3 w4 w5"), (None, "w6 É")]
    return rows, items + [(0, "w20 w21"), (1, items[1][1])]


def answers(found):
    return {(x.item_id, x.rank): (x.doc_id, x.score) for x in found.collect()}


@pytest.mark.parametrize(
    "sizes",
    [
        lexical_search.Sizes(),
        lexical_search.Sizes(
            segment_docs=7, segment_entries=60, held_postings=50, block_terms=20
        ),
    ],
)
def test_search(spark, sizes):
    rows, items = search_rows()
    docs = frame(spark, rows)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("term", "weight", "df", "block", "doc_id")}
    )
    folder = scratch_folder(spark, "index")
    index = lexical_search.build_index(docs, folder, sizes=sizes)
    for top in (5, 50):
        found = answers(lexical_search.search(index, asked, top, sizes))
        want = plain_search(rows, items, top)
        assert found.keys() == want.keys()
        assert found == want


def test_search_in_the_given_documents(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    index = lexical_search.build_index(docs, scratch_folder(spark, "index"))
    found = answers(lexical_search.search(index, items))
    asked = [(x.item_id, x.text) for x in items.collect()]
    assert found == plain_search(pairs(docs), asked, 50)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "...")]])
def test_search_without_terms(spark, rows):
    items = table(spark, SF, "benchmark")
    index = lexical_search.build_index(frame(spark, rows), scratch_folder(spark, "index"))
    assert answers(lexical_search.search(index, items)) == {}


def test_search_for_nothing(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    index = lexical_search.build_index(docs, scratch_folder(spark, "index"))
    assert answers(lexical_search.search(index, items.limit(0))) == {}


def test_bounds():
    """The bound of a segment is what its best document scores, if one has all best counts."""
    row = type("Row", (), {"item_id": 1, "term": "a", "weight": 10})()
    block, visited = lexical_search.Block([row]), lexical_search.Visited(50, 2)
    visited.terms, visited.tfs = [0, 0], [1, 3]
    visited.docs = [np.array([0]), np.array([1])]
    bounds = visited.prepare(block, lexical_search.Ranking())
    assert bounds.tolist() == [visited.scores(block, 0).max()]
