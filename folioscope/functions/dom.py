"""Expressions over the `nodes` array of a shredded page."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions.text import collapse_space, js_trim, let, non_empty

TEXT = "#text"


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def with_tag(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def first(items: Column) -> Column:
    return F.get(items, 0)


def below(nodes: Column, node: Column) -> Column:
    """The node and everything under it: a contiguous run, as seq is the index."""
    return F.slice(nodes, node["seq"] + 1, node["last"] - node["seq"] + 1)


def text_of(nodes: Column, node: Column) -> Column:
    """textContent."""
    texts = F.filter(below(nodes, node), lambda n: n["text"].isNotNull())
    return F.array_join(F.transform(texts, lambda n: n["text"]), "")


def enclosing(nodes: Column, node: Column, kind: str) -> Column:
    """Nearest element of a kind (see schema.NODE) around a node; null when there is none."""
    return F.get(nodes, node["inside"][kind])


def chars(node: Column) -> Column:
    """Visible non-blank characters below a node."""
    return node["stop"] - node["start"]


def prose(node: Column) -> Column:
    """Those outside links."""
    return chars(node) - (node["link_stop"] - node["link_start"])


def meta_content(nodes: Column, key: str, value: str) -> Column:
    """content of the first <meta key=value>; null when blank."""
    hit = first(F.filter(nodes, lambda n: (n["tag"] == "meta") & (attr(n, key) == value)))
    return non_empty(js_trim(attr(hit, "content")))


PARAGRAPHS = ("p", "pre", "blockquote", "li", "td", "dd")

# --- main content ---------------------------------------------------------------

_AD_WORDS = (
    r"(?i)(?:^|[\s_-])(?:ads?|advert|advertisement|sponsor(?:ed)?|banner|sidebar|breadcrumbs?|"
    r"related|comments?|social|newsletter|cookie|pagination|pager|popup)(?:$|[\s_-])"
)
_HIDDEN_STYLE = r"(?i)(?:display\s*:\s*none|visibility\s*:\s*hidden)"


def is_forbidden(n: Column) -> Column:
    return n["tag"].isin(*K.FORBIDDEN_TAGS, "noscript", "template", "head", "title", "link", "meta")


def is_boilerplate(n: Column) -> Column:
    named = F.concat_ws(" ", attr(n, "class"), attr(n, "id"))
    return (
        n["tag"].isin(*K.BOILERPLATE_TAGS)
        | ((F.cardinality(n["attrs"]) > 0) & ~n["tag"].isin("article", "main", "body", "html") & named.rlike(_AD_WORDS))
        | F.coalesce(attr(n, "hidden").isNotNull(), F.lit(False))
        | F.coalesce(attr(n, "aria-hidden") == "true", F.lit(False))
        | F.coalesce(attr(n, "style").rlike(_HIDDEN_STYLE), F.lit(False))
    )


def main_block(nodes: Column) -> Column:
    """seq of the main block: the best <article> or <main>, else the block with most prose.

    A paragraph's prose counts for the block around it, and half of it for the next one out;
    an inner block wins a tie.
    """
    named = F.transform(
        F.filter(
            nodes,
            lambda n: (n["tag"].isin("article", "main") | F.coalesce(attr(n, "role") == "main", F.lit(False)))
            & (prose(n) > 0),
        ),
        lambda n: F.struct(
            (prose(n) * F.when(n["tag"] == "article", 1.5).otherwise(1.0)).alias("score"),
            n["seq"].alias("seq"),
        ),
    )
    paragraphs = F.filter(
        nodes, lambda n: n["tag"].isin(*PARAGRAPHS) & (chars(n) >= 25) & (prose(n) > 0)
    )

    def shares(n: Column) -> Column:
        value = prose(n).cast("double")
        return F.array(
            F.struct(n["parent"].alias("seq"), value.alias("value")),
            F.struct(F.get(nodes, n["parent"])["parent"].alias("seq"), (value / 2).alias("value")),
        )

    nothing = F.struct(
        F.lit(-1).alias("seq"),
        F.lit(0.0).alias("sum"),
        F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("seq")).alias("best"),
    )

    def add(state: Column, share: Column) -> Column:
        before = F.when(state["seq"] == share["seq"], state["sum"]).otherwise(0.0)
        total = before + share["value"]
        scored = F.struct(total.alias("score"), share["seq"].alias("seq"))
        return F.struct(
            share["seq"].alias("seq"),
            total.alias("sum"),
            F.greatest(state["best"], scored).alias("best"),
        )

    # Shares of a block follow each other, so one pass sums them all.
    other = F.aggregate(
        F.sort_array(F.filter(F.flatten(F.transform(paragraphs, shares)), lambda s: s["seq"] >= 0)),
        nothing,
        add,
        lambda state: F.when(state["best"]["seq"] >= 0, state["best"]["seq"]),
    )
    return F.coalesce(F.array_max(named)["seq"], other)


def run(first: Column, past: Column) -> Column:
    """The whole numbers from `first` up to but without `past`."""
    return F.when(past > first, F.sequence(first, past - 1)).otherwise(F.array().cast("array<int>"))


def outside(nodes: Column, root: Column, gone: Column) -> Column:
    """The nodes below `root` that lie in none of the intervals `gone`, array<struct<first, past>>.

    The numbers of the nodes are taken away as a set, in time that grows with the nodes.
    """
    top = F.get(nodes, root)
    hidden = F.flatten(F.transform(gone, lambda g: run(g["first"], g["past"])))
    left = F.array_except(run(root + 1, top["last"] + 1), hidden)
    return let(nodes, lambda all_: F.transform(left, lambda seq: F.get(all_, seq)))


def heading_repeats_title(heading: Column, title: Column) -> Column:
    """The heading is the title, or more than 75 % of its text consists of words of the title.

    Words are of ASCII letters; text without any, as in many languages, is compared as a whole.
    """

    def words(c: Column) -> Column:
        return F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != "")

    def compare(w: Column) -> Column:
        new = F.filter(w["heading"], lambda x: ~F.array_contains(w["title"], x))
        share = F.length(F.array_join(new, " ")) / F.length(F.array_join(w["heading"], " "))
        return (F.size(w["heading"]) > 0) & (F.size(w["title"]) > 0) & (1 - share > 0.75)

    def judge(both: Column) -> Column:
        one, other = both["heading"], both["title"]
        same = (one != "") & (F.lower(one) == F.lower(collapse_space(other)))
        return same | let(F.struct(words(one).alias("heading"), words(other).alias("title")), compare)

    both = F.struct(heading.alias("heading"), title.alias("title"))
    return F.coalesce(let(both, judge), F.lit(False))


# --- table cells ------------------------------------------------------------------


def cell_label(nodes: Column, cell: Column) -> Column:
    """Accessible label of a table cell that replaces its text; null when it has none."""
    labelled = F.filter(
        F.slice(nodes, cell["seq"] + 2, cell["last"] - cell["seq"]),
        lambda n: attr(n, "aria-label").isNotNull(),
    )
    label = js_trim(F.regexp_replace(attr(first(labelled), "aria-label"), r"(?i)\s+share$", ""))
    return let(label, lambda text: F.when(text.rlike(r"\d|%"), text))


def repaired_cells(nodes: Column) -> Column:
    """array<struct<seq, last, label>> of the cells whose text is replaced."""
    return F.filter(
        F.transform(
            with_tag(nodes, "td", "th"),
            lambda c: F.struct(
                c["seq"].alias("seq"), c["last"].alias("last"), cell_label(nodes, c).alias("label")
            ),
        ),
        lambda c: c["label"].isNotNull(),
    )


def code_language(code: Column) -> Column:
    return non_empty(F.regexp_extract(attr(code, "class"), r"(?:language-|lang-)([\w-]+)", 1))


def collapsed_text(nodes: Column, node: Column) -> Column:
    return collapse_space(text_of(nodes, node))
