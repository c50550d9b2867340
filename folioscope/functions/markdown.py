"""Markdown rendering of a node array, as Catalyst expressions.

Every kept node yields an opening and a closing piece; sorted by position and joined they
are the document. Block borders are control-character tokens that carry the line prefix
of their container (list indent, quote mark); a few replacements then merge neighbouring
borders and turn them into line breaks.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import dom
from folioscope.functions.dom import attr
from folioscope.functions.text import let, normalize_markdown

# Control characters that mark up the joined text until the last step.
OPEN, LINE, BREAK = chr(0x05), chr(0x06), chr(0x0E)  # OPEN units LINE | OPEN units BREAK
QUOTE, INDENT = chr(0x11), chr(0x12)  # units of a line prefix
GLUE = chr(0x13)  # swallow the borders that follow a list marker or quote mark
START, STOP, END = chr(0x14), chr(0x15), chr(0x16)  # START mark END text STOP mark END
CODE_LINE, CODE_SPACE = chr(0x17), chr(0x18)
BR, BR_END = chr(0x19), chr(0x1A)
_CONTROL = r"[\x05-\x1a&&[\x05\x06\x0e\x11-\x1a]]"
_UNITS = r"[\x11\x12]"
_BORDER = rf"\x05{_UNITS}*[\x06\x0e]"

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (
    "p", "div", "section", "article", "main", "figure", "figcaption", "header", "footer",
    "address", "dl", "dt", "dd", "details", "summary", "table", "center", "fieldset",
    "aside", "nav", "hgroup", "body", "form",
)
STRONG, EMPHASIS, STRUCK = ("b", "strong"), ("i", "em"), ("s", "del", "strike")


def escape_text(text: Column) -> Column:
    """Protect characters that Markdown would read as markup."""
    special = r"[\\*`\[\]_]"
    at_start = r"^(-|\+ |=+|#{1,6} |~~~|>)"
    numbered = r"^(\d+)\. "

    def escaped(t: Column) -> Column:
        found = F.regexp_replace(t, rf"({special})", r"\\$1")
        found = F.regexp_replace(found, at_start, r"\\$1")
        found = F.regexp_replace(found, numbered, r"$1\\. ")
        return F.when(t.rlike(rf"{special}|{at_start}|{numbered}"), found).otherwise(t)

    return let(text, escaped)


def _border(units: Column, kind: str) -> Column:
    return F.concat(F.lit(OPEN), units, F.lit(kind))


def _mark(kind: str, mark: Column | str) -> Column:
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return F.concat(F.lit(kind), mark, F.lit(END))


def _text_piece(n: Column) -> Column:
    clean = F.regexp_replace(n["text"], _CONTROL, "")
    as_code = F.replace(
        F.translate(clean, " \r", CODE_SPACE),
        F.lit("\n"),
        F.concat(F.lit(CODE_LINE), n["units"]),
    )
    flat = F.regexp_replace(clean, r"[ \t\r\n]+", " ")
    led = F.when(n["first"], F.ltrim(flat)).otherwise(flat)
    inline_code = F.translate(flat, " ", CODE_SPACE)
    return F.when(n["raw"], as_code).when(n["code"], inline_code).otherwise(escape_text(led))


def node_contexts(page: Column) -> Column:
    """The kept nodes, each with what its surroundings say and what stands for it.

    page: struct<nodes, kept, root, images, anchor_urls, slots, marks>; the texts `marks` stand
    in the empty boxes `slots`, one each. Result: array<struct<seq, last, first, nth, tag, text,
    title, parent, start, units, raw, code, cell, language, href, image, label, cells>>.
    Everything is found by position, so the work grows with the nodes.
    """

    def context(p: Column, n: Column) -> Column:
        nodes, parent = p["nodes"], F.get(p["nodes"], n["parent"])
        around = F.get(nodes, p["root"])["marks"]
        within = lambda kind: n["inside"][kind] >= p["root"]
        is_cell = n["tag"].isin("td", "th")
        background = F.when(
            attr(n, "style").isNotNull(), F.try_element_at(p["backgrounds"], n["seq"])
        )
        return F.struct(
            n["seq"].alias("seq"),
            n["last"].alias("last"),
            (n["seq"] == n["parent"] + 1).alias("first"),
            n["nth"].alias("nth"),
            n["tag"].alias("tag"),
            n["text"].alias("text"),
            attr(n, "title").alias("title"),
            parent["tag"].alias("parent"),
            attr(parent, "start").alias("start"),
            F.translate(
                F.substring(n["marks"], F.length(around) + 1, F.length(n["marks"])),
                "lb",
                INDENT + QUOTE,
            ).alias("units"),
            within("pre").alias("raw"),
            within("code").alias("code"),
            within("cell").alias("cell"),
            F.when(
                n["tag"] == "pre",
                F.coalesce(
                    dom.code_language(F.get(nodes, n["seq"] + 1)), dom.code_language(n)
                ),
            ).alias("language"),
            F.when(
                (n["tag"] == "a") & attr(n, "href").isNotNull(), F.get(p["urls"], n["links"])
            ).alias("href"),
            F.coalesce(
                F.when(n["tag"] == "img", F.get(p["shown"], n["images"])).otherwise(background),
                F.lit(""),
            ).alias("image"),
            F.when(is_cell, dom.cell_label(nodes, n))
            .when(
                (n["tag"] == "div") & F.array_contains(p["slots"], n["seq"]),
                F.get(p["marks"], F.array_position(p["slots"], n["seq"]).cast("int") - 1),
            )
            .alias("label"),
            F.when(n["tag"] == "tr", header_cells(p, n)).alias("cells"),
        )

    def prepared(p: Column) -> Column:
        """Images by number of <img>, those of other elements by seq; tables with a head."""
        is_img = lambda i: F.get(p["nodes"], i["seq"])["tag"] == "img"
        others = F.filter(p["images"], lambda i: ~is_img(i) & i["src"].isNotNull())
        heads = F.filter(p["nodes"], lambda c: (c["tag"] == "thead") & (c["last"] > c["seq"]))
        return F.struct(
            p["nodes"].alias("nodes"),
            p["kept"].alias("kept"),
            p["root"].alias("root"),
            p["anchor_urls"].alias("urls"),
            p["slots"].alias("slots"),
            p["marks"].alias("marks"),
            F.transform(F.filter(p["images"], is_img), image_text).alias("shown"),
            F.map_from_entries(
                F.transform(others, lambda i: F.struct(i["seq"], image_text(i)))
            ).alias("backgrounds"),
            F.transform(heads, lambda c: c["inside"]["table"]).alias("headed"),
        )

    return let(let(page, prepared), lambda p: F.transform(p["kept"], lambda n: context(p, n)))


def header_cells(p: Column, n: Column) -> Column:
    """Cells of a table row that is followed by a rule; null for other rows."""
    nodes, parent = p["nodes"], F.get(p["nodes"], n["parent"])
    has_head = F.array_contains(p["headed"], n["inside"]["table"])
    first_group = (parent["nth"] == 1) | (F.get(nodes, parent["seq"] - 1)["tag"] == "table")
    leads = (n["nth"] == 1) & (
        (parent["tag"] == "thead") | (~has_head & ((parent["tag"] != "tbody") | first_group))
    )
    cells = F.filter(
        dom.below(nodes, n), lambda c: c["tag"].isin("td", "th") & (c["parent"] == n["seq"])
    )
    return F.when(leads, F.size(cells))


def image_text(image: Column) -> Column:
    """An image in Markdown; null without an address."""
    return F.concat(
        F.lit("!["),
        F.regexp_replace(image["alt"], r"[\[\]]", ""),
        F.lit("]("),
        image["src"],
        F.lit(")"),
    )


def _pieces(n: Column) -> Column:
    """Opening and closing piece of one node, as (pos, order, tie, piece)."""
    tag, units = n["tag"], n["units"]
    raw = n["raw"]
    space = lambda border: F.when(n["cell"], F.lit(" ")).otherwise(border)
    para, line = space(_border(units, BREAK)), space(_border(units, LINE))
    level = F.greatest(F.lit(2), F.substring(tag, 2, 1).try_cast("int"))
    nested_list = F.when(n["parent"] == "li", line).otherwise(para)
    start_at = F.coalesce(n["start"].try_cast("int"), F.lit(1))
    bullet = F.when(
        n["parent"] == "ol",
        F.concat((start_at + n["nth"] - 1).cast("string"), F.lit("." + 2 * CODE_SPACE)),
    ).otherwise(F.lit("-" + 3 * CODE_SPACE))
    label, image, cells = n["label"], n["image"], n["cells"]
    href = F.regexp_replace(n["href"], r"([()])", r"\\$1")
    title = F.when(
        F.coalesce(n["title"], F.lit("")) != "",
        F.concat(F.lit(' "'), n["title"], F.lit('"')),
    ).otherwise("")
    fence = F.lit("```")

    opening = (
        F.when(tag == dom.TEXT, _text_piece(n))
        .when(raw, F.lit(""))
        .when(tag.isin(*HEADINGS), F.concat(para, F.repeat(F.lit("#"), level), F.lit(" ")))
        .when(tag.isin(*BLOCKS), F.concat(para, F.coalesce(label, F.lit(""))))
        .when(tag.isin("ul", "ol"), nested_list)
        .when(tag == "li", F.concat(line, bullet, F.lit(GLUE)))
        .when(tag == "blockquote", F.concat(para, F.lit(QUOTE + GLUE)))
        .when(
            tag == "pre",
            F.concat(para, fence, F.coalesce(n["language"], F.lit("")), F.lit(CODE_LINE), units),
        )
        .when(tag == "code", F.lit("`"))
        .when(tag == "hr", F.concat(para, F.lit("* * *"), para))
        .when(tag == "br", space(F.concat(F.lit(BR), units, F.lit(BR_END))))
        .when(tag.isin(*STRONG), _mark(START, "**"))
        .when(tag.isin(*EMPHASIS), _mark(START, "*"))
        .when(tag.isin(*STRUCK), _mark(START, "~"))
        .when((tag == "a") & href.isNotNull(), _mark(START, "["))
        .when(tag == "img", image)
        .when(tag == "tr", F.concat(line, F.lit("|")))
        .when(tag.isin("td", "th"), F.concat(F.lit(" "), F.coalesce(escape_text(label), F.lit(""))))
        .otherwise("")
    )
    closing = (
        F.when(raw | tag.isin(dom.TEXT, "img"), F.lit(""))
        .when(tag.isin(*HEADINGS, "blockquote"), para)
        # A background image is appended to its element.
        .when(tag.isin(*BLOCKS), F.concat(image, para))
        .when(tag.isin("ul", "ol"), nested_list)
        .when(tag == "li", F.concat(image, line))
        .when(tag == "pre", F.concat(F.lit(CODE_LINE), units, fence, para))
        .when(tag == "code", F.lit("`"))
        .when(tag.isin(*STRONG), _mark(STOP, "**"))
        .when(tag.isin(*EMPHASIS), _mark(STOP, "*"))
        .when(tag.isin(*STRUCK), _mark(STOP, "~"))
        .when(
            (tag == "a") & href.isNotNull(),
            _mark(STOP, F.concat(F.lit("]("), href, title, F.lit(")"))),
        )
        .when(tag.isin("td", "th"), F.lit(" |"))
        .when(
            (tag == "tr") & cells.isNotNull(),
            F.concat(_border(units, LINE), F.lit("|"), F.repeat(F.lit(" --- |"), cells)),
        )
        .otherwise(image)
    )
    piece = lambda pos, order, tie, text: F.struct(
        pos.alias("pos"), F.lit(order).alias("order"), tie.alias("tie"), text.alias("piece")
    )
    return F.array(piece(n["seq"], 0, F.lit(0), opening), piece(n["last"], 1, -n["seq"], closing))


def _when_any(marks: str, c: Column, step) -> Column:
    """Apply `step` only to texts that contain one of the characters.

    Most pages have no lists, quotes or code; a look for a character is far cheaper than
    a pass of the matcher over the whole text.
    """

    def guarded(text: Column) -> Column:
        present = F.lit(False)
        for mark in marks:
            present = present | F.contains(text, F.lit(mark))
        return F.when(present, step(text)).otherwise(text)

    return let(c, guarded)


def _merge_nested(c: Column) -> Column:
    """Of neighbouring borders keep the outermost, and a paragraph break over a line."""
    for _ in range(2):
        c = F.regexp_replace(c, rf"\x05({_UNITS}*){_UNITS}+[\x06\x0e](?=\x05\1[\x06\x0e])", "")
        c = F.regexp_replace(c, rf"(\x05({_UNITS}*)[\x06\x0e])(?:\x05\2{_UNITS}+[\x06\x0e])+", "$1")
    c = F.regexp_replace(c, rf"(?:\x05{_UNITS}*\x06)+(?=\x05{_UNITS}*\x0e)", "")
    c = F.regexp_replace(c, rf"(\x05{_UNITS}*\x0e)(?:{_BORDER})+", "$1")
    return F.regexp_replace(c, rf"(\x05{_UNITS}*\x06)(?:\x05{_UNITS}*\x06)+", "$1")


def _line_breaks(c: Column) -> Column:
    """A <br> next to a border is swallowed by it."""
    c = F.regexp_replace(c, rf" *(\x19{_UNITS}*\x1a) *", "$1")
    c = F.regexp_replace(c, rf"(?:\x19{_UNITS}*\x1a)+(?=\x05)", "")
    return F.regexp_replace(c, rf"({_BORDER})(?:\x19{_UNITS}*\x1a)+", "$1")


def _outer_blanks(c: Column) -> Column:
    """Blanks at the edge of bold, links and so on belong outside the marks."""
    c = F.regexp_replace(c, r"((?:\x14[^\x16]*\x16)+) +", " $1")
    return F.regexp_replace(c, r" +((?:\x15[^\x16]*\x16)+)", "$1 ")


def _settle(joined: Column) -> Column:
    """Merge borders and replace all control characters."""
    c = F.regexp_replace(joined, " {2,}", " ")
    c = _when_any(GLUE, c, lambda t: F.regexp_replace(t, rf"\x13(?: |{_BORDER})*", ""))
    c = F.regexp_replace(c, rf" ?({_BORDER})(?: |\1)*", "$1")
    c = _when_any(LINE + QUOTE + INDENT, c, _merge_nested)
    c = _when_any(BR, c, _line_breaks)
    c = _when_any(START, c, _outer_blanks)
    c = _when_any(
        CODE_LINE,
        c,
        lambda t: F.regexp_replace(t, rf"\x17({_UNITS}*)\x17\1(```)(?=\x05)", "\x17$1$2"),
    )
    c = F.regexp_replace(c, rf"\x05({_UNITS}*)\x0e", "\n$1\n$1")
    c = _when_any(
        LINE + BR_END, c, lambda t: F.regexp_replace(t, rf"[\x05\x19]({_UNITS}*)[\x06\x1a]", "\n$1")
    )
    c = _when_any(
        CODE_LINE + CODE_SPACE + START,
        c,
        lambda t: F.translate(t, CODE_LINE + CODE_SPACE + START + STOP + END, "\n "),
    )
    return F.replace(F.replace(c, F.lit(QUOTE), F.lit("> ")), F.lit(INDENT), F.lit("    "))


def document(contexts: Column) -> Column:
    """Markdown from the node contexts of a page."""
    events = F.flatten(F.transform(contexts, _pieces))
    # sort_array compares structs natively, array_sort by an interpreted function.
    joined = F.array_join(F.sort_array(events)["piece"], "")
    return normalize_markdown(_settle(joined))
