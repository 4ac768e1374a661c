"""Markup to clean text, and removal of elements that a host repeats on many of its pages: problem 4.

A page is parsed into element subtrees (nested HTML blocks, wiki templates and tables). Their hashes are
counted per host; a subtree that stands on many pages of its host is site furniture and is deleted. What
remains is turned into clean text in one canonical notation: `#` headings, `-` lists, fenced code,
`$`-delimited formulas, ` | ` between table cells. The same recognisers tell which notations a field uses.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.operators import skew
from loomrank.sources.dump import delivered_once
from loomrank.sources.tables import local_table, saved, spread, table

KINDS = ("html", "markdown", "wiki", "latex")
#: A subtree is furniture if it stands on so many pages of its host, and on this share of them.
FURNITURE_PAGES, FURNITURE_SHARE = 10, 0.02
#: Letters a subtree holds at least to be counted.
SUBTREE_LETTERS = 12

# -- recognisers

CODE = re.compile(
    r"(?P<fence>^[ ]{0,3}(?P<mark>`{3,}|~{3,})(?P<lang>[^\n`]*)\n(?P<body>.*?)(?:^[ ]{0,3}(?P=mark)[`~]*[ \t]*$|\Z))"
    r"|(?P<verbatim>\\begin\{(?P<env>verbatim|Verbatim|lstlisting|minted)\*?\}(?P<vbody>.*?)(?:\\end\{(?P=env)\*?\}|\Z))"
    r"|(?P<verb>\\verb\*?(?P<d>[|!+/@])(?P<verbody>[^\n]*?)(?P=d))"
    r"|(?P<multi>(?<!`)(?P<ticks>`{2,})(?!`)(?P<mbody>[^\n]+?)(?<!`)(?P=ticks)(?!`))"
    r"|(?P<span>(?<!`)`(?![`\s])(?P<sbody>[^`\n]*)(?<!\s)`(?!`))",
    re.M | re.S,
)
ATTRIBUTE = r"""\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+)"""
FLAG = r"\s+(?:checked|compact|controls|defer|async|disabled|hidden|ismap|multiple|nohref|noshade|nowrap|open|readonly|required|reversed|selected)"
TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:{ATTRIBUTE}|{FLAG})*)\s*/?>")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>", re.S | re.I)
REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")

WIKI_HEADING = re.compile(r"^(={1,6})(?!=)[ \t]*(\S.*?)[ \t]*(?<!=)\1[ \t]*$", re.M)
WIKI_LINK = re.compile(r"\[\[[^\[\]\n]+\]\]")
WIKI_URL = re.compile(r"\[(?:[a-z][a-z0-9+.-]*:)?//[^\s\]]+(?:[ \t]+([^\]\n]*))?\](?!\()")
WIKI_TEMPLATE = re.compile(r"\{\{[^{}]+\}\}")
WIKI_TABLE = re.compile(r"^[ \t:]*\{\|", re.M)
WIKI_EMPHASIS = re.compile(r"(?<!')'{2,5}(?=[^'\s])[^\n]*?(?<!\s)'{2,5}")

MD_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
MD_SETEXT = re.compile(r"^(?![ \t]*[|=#>*+`~{!-])[ ]{0,3}(\S[^\n]*)\n {0,3}(={3,}|-{3,})[ \t]*$", re.M)
MD_LINK = re.compile(r"(?<![\w\]])(!?)\[([^\[\]\n]*)\]\([^\s()]*(?:\([^\s()]*\)[^\s()]*)?(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)")
MD_DEFINITION = re.compile(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]*\S+.*$", re.M)
MD_REFERENCE = re.compile(r"(!?)\[([^\[\]\n]+)\][ ]?\[([^\[\]\n]*)\]")
MD_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
MD_TABLE = re.compile(r"^ {0,3}(?=[^\n]*\|)\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$", re.M)
MD_TASK = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\[[ xX]\][ \t]+\S", re.M)
MD_STRIKE = re.compile(r"(?<![~\w])~~(?![~\s])([^~\n]+?)(?<!\s)~~(?![~\w])")
MD_STARS = re.compile(r"(?<![\w*\\])(\*{1,3})(?![*\s])([^*\n]+?)(?<!\s)\1(?![\w*])")
MD_LINES = re.compile(r"(?<![\w\\])(_{1,3})(?![_\s])([^\n]*?[^\s_])\1(?!\w)")
MAGIC = re.compile(r"__(?:NO)?(?:TOC|EDITSECTION|INDEX|GALLERY|FORCETOC|HIDDENCAT)__")

TEX_COMMAND = re.compile(r"(?<![\\\w])\\[A-Za-z]+\*?|(?<=\w)\\[A-Za-z]+\*?(?=\{)")
TEX_DISPLAY = re.compile(r"\$\$(?=[^$])(.+?)\$\$|(?<!\\)\\\[(.+?)\\\]", re.S)
TEX_INLINE = re.compile(r"(?<!\\)\\\((.+?)\\\)|(?<![\\$\w])\$(?![\s$])([^$\n]*?)(?<![\s\\])\$(?![\w$])", re.S)
PRICE = re.compile(r"\d[\d.,]*(?:\s+[A-Za-z]{2,}|[\s–-]*$)")


def _formula(m: re.Match) -> bool:
    body = m[2]
    return body is None or not PRICE.match(body)


def _reference(m: re.Match) -> bool:
    return m[1] is None or m[1] + ";" in html5


def _may_hold_code(t: str) -> bool:
    return "`" in t or "~~~" in t or ("\\" in t and ("\\verb" in t or "{verbatim" in t or "{Verbatim" in t or "{lstlisting" in t or "{minted" in t))


def mask(text: str) -> tuple[str, set[str], list[re.Match]]:
    """text with Markdown code and LaTeX verbatim replaced by placeholders; the kinds they show; the pieces."""
    if not _may_hold_code(text):
        return text, set(), []
    kinds, pieces = set(), []

    def swap(m: re.Match) -> str:
        kinds.add("latex" if m["verbatim"] or m["verb"] else "markdown")
        pieces.append(m)
        return f"\x00{len(pieces) - 1}\x01"

    return CODE.sub(swap, text), kinds, pieces


def kinds_of(text: str | None, masked: tuple | None = None) -> list[str]:
    """The notations of which text holds at least one construct; none for null and empty text."""
    if not text:
        return []
    t, code, _ = masked or mask(text)
    kinds = set(code)
    if ("<" in t and ("<!" in t and COMMENT.search(t) or TAG.search(t))) or ("&" in t and any(map(_reference, REFERENCE.finditer(t)))):
        kinds.add("html")
    if (
        ("[" in t and (WIKI_LINK.search(t) or "//" in t and WIKI_URL.search(t)))
        or ("{" in t and (WIKI_TEMPLATE.search(t) or WIKI_TABLE.search(t)))
        or ("''" in t and WIKI_EMPHASIS.search(t))
        or ("=" in t and WIKI_HEADING.search(t))
    ):
        kinds.add("wiki")
    if "markdown" not in kinds and (
        ("#" in t and MD_HEADING.search(t))
        or ("](" in t and MD_LINK.search(t))
        or ("]:" in t and _defined(t))
        or ("*" in t and MD_STARS.search(t))
        or ("_" in t and MD_LINES.search(MAGIC.sub("", t)))
        or ("~~" in t and MD_STRIKE.search(t))
        or ("---" in t and MD_TABLE.search(t))
        or ("] " in t and MD_TASK.search(t))
        or (("===" in t or "---" in t) and MD_SETEXT.search(t))
        or ("<" in t and MD_AUTOLINK.search(t))
    ):
        kinds.add("markdown")
    if "latex" not in kinds and (
        ("\\" in t and (TEX_COMMAND.search(t) or ("\\[" in t and TEX_DISPLAY.search(t)) or ("\\(" in t and TEX_INLINE.search(t))))
        or (t.count("$") > 1 and (TEX_DISPLAY.search(t) or any(map(_formula, TEX_INLINE.finditer(t)))))
    ):
        kinds.add("latex")
    return [k for k in KINDS if k in kinds]


def _defined(t: str) -> bool:
    """Whether a reference link has its definition, or a definition stands there at all."""
    return MD_DEFINITION.search(t) is not None


# -- element subtrees

PAIRED = "div|p|table|ul|ol|dl|section|article|header|footer|nav|aside|center|blockquote|pre|form|figure|gallery|small|span"
NODE = re.compile(rf"<(/?)({PAIRED})\b(?:{ATTRIBUTE}|{FLAG})*\s*>|(\{{\{{|\{{\|)|(\}}\}}|\|\}})", re.I)
BLANKS = re.compile(r"\s+")


def subtrees(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, hash) of every closed element of text, inner ones before the outer ones.

    The hash covers the element's source without regard to case and white space.
    """
    if not text or ("<" not in text and "{" not in text):
        return []
    out, stack = [], []
    places: dict[str, list[int]] = {}  # where in stack each element name is open
    for m in NODE.finditer(text):
        name = (m[2] or "").lower() or {"{{": "t", "}}": "t", "{|": "w", "|}": "w"}[m[0]]
        if m[1] == "/" or m[4]:
            if places.get(name):
                at = places[name][-1]
                start = stack[at][1]
                for inner, _ in stack[at:]:
                    places[inner].pop()
                del stack[at:]
                source = text[start : m.end()]
                if sum(map(str.isalpha, source)) >= SUBTREE_LETTERS:
                    out.append((start, m.end(), xxhash.xxh64_intdigest(BLANKS.sub(" ", source).casefold()) - 2**63))
        else:
            places.setdefault(name, []).append(len(stack))
            stack.append((name, m.start()))
    return out


def without(text: str, hashes: set[int]) -> str:
    """text without the elements whose hashes are given."""
    cut = sorted((a, b) for a, b, h in subtrees(text) if h in hashes)
    out, at = [], 0
    for a, b in cut:
        if b > at:
            out.append(text[at : max(a, at)])
            at = b
    return "".join(out) + text[at:]


# -- clean text

SCRIPT = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
MATH = re.compile(r"<math\b[^>]*>(.*?)</math\s*>", re.S | re.I)
PRE = re.compile(r"<pre\b[^>]*>(.*?)</pre\s*>", re.S | re.I)
HTML_HEADING = re.compile(r"<h([1-6])\b[^>]*>\s*(.*?)\s*</h\1\s*>", re.S | re.I)
ALT = re.compile(r"""\balt\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
INFOBOX = re.compile(r"\{\{[ \t]*Infobox\b[^|{}]*((?:\|[^{}]*)?)\}\}", re.I)
BREAKING = frozenset("p div br hr tr table ul ol dl dt dd blockquote section article header footer nav aside center figure".split())
EQUATION = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
TABULAR = re.compile(r"\\begin\{(tabular|array|tabularx|longtable)\*?\}(?:\{[^{}]*\})*(.*?)\\end\{\1\*?\}", re.S)
SECTION = re.compile(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}")
LEVEL = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
STYLED = re.compile(r"\\(?:emph|text[a-z]{2}|underline|mbox|textnormal|textcolor\{[^{}]*\}|href\{[^{}]*\}|url)\{([^{}]*)\}")
NOTE = re.compile(r"\\footnote\{([^{}]*)\}")
SILENT = re.compile(r"\\(?:cite[a-z]*|label|ref|eqref|pageref|index|usepackage|documentclass|bibliography\w*|vspace|hspace)\*?(?:\[[^\[\]]*\])*\{[^{}]*\}")
LISTING = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]]*\])?")
ITEM = re.compile(r"\\item\b[ \t]*(?:\[([^\]]*)\])?[ \t]*")
LONE_TEX = re.compile(r"(?<![\\\w$])\\[A-Za-z]+(?:\{[^{}]*\})*")
HELD = re.compile("\x00(\\d+)\x01")
BULLET = re.compile(r"^(\*{1,6})[ \t]+(?=[^*\s])", re.M)
TRAILING = re.compile(r"[ \t]+(?=\n)")
LATER_BLANKS = re.compile(r"(?<=\S)(?:  |\t)[ \t]*")
EMPTY_LINES = re.compile(r"\n{3,}")


def clean(text: str | None, kinds: list[str] | None = None) -> str | None:
    """text without markup; headings, lists, code and formulas stay in one notation. Null stays null.

    kinds: kinds_of(text), if known; only the stages of these notations run.
    """
    if not text:
        return text
    kinds = kinds_of(text) if kinds is None else kinds
    held: list[str] = []
    t = text.replace("\x00", "").replace("\x01", "").replace("\r\n", "\n")

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x01"

    def code(m: re.Match) -> str:
        if m["fence"]:
            return hold(f"```{m['lang'].strip()}\n{m['body'].rstrip()}\n```")
        if m["verbatim"]:
            return hold(f"```\n{m['vbody'].strip(chr(10))}\n```")
        return hold(f"`{(m['verbody'] or m['mbody'] or m['sbody'] or '').strip()}`")

    if _may_hold_code(t):
        t = CODE.sub(code, t)
    if "html" in kinds and "<" in t:
        t = SCRIPT.sub("", COMMENT.sub("", t))
        t = MATH.sub(lambda m: hold(f"${m[1].strip()}$"), t)
        t = PRE.sub(lambda m: "\n" + hold(f"```\n{html.unescape(TAG.sub('', m[1])).strip(chr(10))}\n```") + "\n", t)
    if "latex" in kinds:
        t = EQUATION.sub(lambda m: hold(f"$$\n{m[3].strip()}\n$$"), t)
    if "latex" in kinds and ("$" in t or "\\[" in t or "\\(" in t):
        t = TEX_DISPLAY.sub(lambda m: hold(f"$${(m[1] or m[2]).strip()}$$"), t)
        t = TEX_INLINE.sub(lambda m: hold(f"${(m[1] or m[2]).strip()}$") if _formula(m) else m[0], t)
    if "wiki" in kinds:
        t = _wiki(t)
    if "markdown" in kinds:
        t = _markdown(t)
    if "latex" in kinds:
        t = _tex(t, hold)
    if "html" in kinds:
        if "<" in t:
            t = HTML_HEADING.sub(lambda m: f"\n{'#' * int(m[1])} {BLANKS.sub(' ', m[2])}\n", t)
            t = TAG.sub(_tag, t)
        if "&" in t:
            t = REFERENCE.sub(lambda m: html.unescape(m[0]).replace("\xa0", " ") if _reference(m) else m[0], t)
    if "*" in t:
        t = BULLET.sub(lambda m: "  " * (len(m[1]) - 1) + "- ", t)
    if "  " in t or "\t" in t or " \n" in t:
        t = LATER_BLANKS.sub(" ", TRAILING.sub("", t))
    while HELD.search(t):  # a held piece may hold earlier ones
        t = HELD.sub(lambda m: held[int(m[1])], t)
    return (EMPTY_LINES.sub("\n\n", t) if "\n\n\n" in t else t).strip()


def _tag(m: re.Match) -> str:
    name = m[2].lower()
    if name == "li":
        return "" if m[1] else "\n- "
    if name in ("td", "th"):
        return " | " if m[1] else ""
    if name == "img":
        alt = ALT.search(m[3])
        return alt[1].strip("\"'") if alt else ""
    return "\n" if name in BREAKING else ""


def _infobox(m: re.Match) -> str:
    pairs = (p.partition("=") for p in m[1].split("|") if "=" in p)
    return "\n".join(f"- {k.strip()}: {v.strip()}" for k, _, v in pairs)


def _link(m: re.Match) -> str:
    parts = m[0][2:-2].split("|")
    target = parts[0].strip()
    space, colon, _ = target.partition(":")
    if colon and space.strip().lower() in ("file", "image"):
        return parts[-1].strip() if len(parts) > 1 else ""
    if colon and space.strip().lower() == "category":
        return ""
    return parts[-1].strip() or target.lstrip(":")


def _wiki(t: str) -> str:
    while True:  # inside out; each pass takes brackets or braces away
        new = WIKI_LINK.sub(_link, t)
        new = WIKI_TEMPLATE.sub("", INFOBOX.sub(_infobox, new))
        if new == t:
            break
        t = new
    t = WIKI_URL.sub(lambda m: (m[1] or "").strip(), t)
    t = WIKI_HEADING.sub(lambda m: f"{'#' * len(m[1])} {m[2]}", t)
    t = WIKI_EMPHASIS.sub(lambda m: m[0].strip("'") if m[0].count("''") else m[0], t)
    if "{|" in t:
        t = _tables(t)
    return re.sub(r"^;[ \t]*([^:\n]+?)[ \t]*:[ \t]*", r"- \1: ", t, flags=re.M)


def _tables(t: str) -> str:
    out, inside = [], False
    for line in t.split("\n"):
        s = line.strip()
        if s.startswith("{|"):
            inside = True
        elif inside and s.startswith("|}"):
            inside = False
            if s[2:].strip():
                out.append(s[2:].strip())
        elif inside:
            if s.startswith("|-"):
                continue
            out.append(" | ".join(c.strip() for c in re.split(r"\|\||!!", s[1:])) if s[:1] in "|!" else line)
        else:
            out.append(line)
    return "\n".join(out)


def _markdown(t: str) -> str:
    t = MD_HEADING.sub(lambda m: f"{m[1]} {m[2]}", t) if "#" in t else t
    if "===" in t or "---" in t:
        t = MD_SETEXT.sub(lambda m: f"{'#' if m[2][0] == '=' else '##'} {m[1].strip()}", t)
        t = MD_TABLE.sub("", t)
    if "](" in t:
        t = MD_LINK.sub(lambda m: m[2], t)
    if "]:" in t:
        names = {m[1].lower() for m in MD_DEFINITION.finditer(t)}
        t = MD_DEFINITION.sub("", t)
        t = MD_REFERENCE.sub(lambda m: m[2] if (m[3] or m[2]).lower() in names else m[0], t)
    for pattern, sign in ((MD_STARS, "*"), (MD_LINES, "_")):
        if sign in t:
            t = pattern.sub(lambda m: m[2], t)
    return MD_STRIKE.sub(lambda m: m[1], t) if "~~" in t else t


def _tex(t: str, hold) -> str:
    t = SECTION.sub(lambda m: f"\n{'#' * LEVEL[m[1]]} {m[2]}\n", t)
    t = TABULAR.sub(lambda m: "\n".join(" | ".join(c.strip() for c in row.split("&")) for row in re.split(r"\\\\", m[2]) if row.strip()), t)
    t = ITEM.sub(lambda m: f"- {m[1]}: " if m[1] else "- ", SILENT.sub("", t))
    while True:
        new = NOTE.sub(r" (\1)", STYLED.sub(r"\1", t))
        if new == t:
            break
        t = new
    return LONE_TEX.sub(lambda m: hold(f"${m[0]}$"), LISTING.sub("", t))


# -- Spark

_PAGES = ["page_id", "host", "title", "text"]


def _rows(page: DataFrame) -> DataFrame:
    """(page_id, host, title, text), one row per page: of repeated deliveries the first loaded; rows without page_id are ignored."""
    once = spread(delivered_once(page, "page_id", ["page_id", "file_name", "title", "text"]), "page_id", page)
    return once.select("page_id", F.coalesce("file_name", F.lit("")).alias("host"), "title", "text")


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pages, hosts, hashes = [], [], []
        for page, host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
            for h in {h for _, _, h in subtrees(text)}:
                pages.append(page), hosts.append(host), hashes.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], names=["page_id", "host", "h"])


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for b in batches:
        title, text, cut = (b.column(i).to_pylist() for i in (2, 3, 4))
        kinds = [[kinds_of(x) for x in field] for field in (title, text)]
        kept = [clean(without(x, set(c))) if c and x else clean(x, k) for x, c, k in zip(text, cut, kinds[1])]
        columns = [
            b.column(0), b.column(1), pa.array(map(clean, title, kinds[0]), pa.string()), pa.array(kept, pa.string()),
            pa.array(kinds[0], strings), pa.array(kinds[1], strings), pa.array([len(c or ()) for c in cut], pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "title", "text", "title_kinds", "text_kinds", "removed"])


def furniture(pages: DataFrame, least: int = FURNITURE_PAGES, share: float = FURNITURE_SHARE) -> tuple[DataFrame, DataFrame]:
    """(subtrees of pages: page_id, host, h; those of them that stand on many pages of their host: host, h, n). Pages are parsed once."""
    found = saved(pages.mapInArrow(_hash, "page_id bigint, host string, h bigint"), "subtrees")
    sizes = pages.groupBy("host").agg(F.count("*").alias("size"))
    often = found.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found, saved(often.join(sizes, "host").where(F.col("n") >= share * F.col("size")).select("host", "h", "n"), "furniture")


def _cuts(found: DataFrame, often: DataFrame) -> DataFrame:
    """(page_id, cut): the furniture on each page. Subtrees with a heavy share of all are known by their count, and broadcast."""
    key = F.concat_ws("|", F.col("h").cast("string"), "host").alias("k")
    least = max(skew.LEAST_ROWS, skew.heavy_share(found.sparkSession) * found.count())
    heavy = local_table(found.sparkSession, often.where(F.col("n") >= least).select(key, "n").collect(), "k string, estimate bigint")
    hits = skew.skew_join(found.select("page_id", key, "h"), often.select(key), "k", heavy=heavy)
    return saved(hits.groupBy("page_id").agg(F.collect_list("h").alias("cut")), "cuts")  # of one page


def clean_pages(page: DataFrame, least: int = FURNITURE_PAGES, share: float = FURNITURE_SHARE) -> DataFrame:
    """(page_id, host, title, text, title_kinds, text_kinds, removed): every page once, as clean text.

    page: as the table of that name; its file_name is the host, null counting as ''. *_kinds lists the notations
    found in the field as delivered; removed counts the kinds of furniture deleted from the text. Null fields stay
    null and empty ones empty, both without kinds. Of rows of one page_id the first loaded counts; rows without
    page_id are ignored; an empty table gives no rows; other columns are ignored.
    """
    pages = _rows(page)
    found, often = furniture(pages, least, share)
    none = F.lit(None).cast("array<bigint>").alias("cut")
    cut = pages.select(*_PAGES, none) if often.isEmpty() else skew.lookup(pages, _cuts(found, often), "page_id", "left")
    schema = "page_id bigint, host string, title string, text string, title_kinds array<string>, text_kinds array<string>, removed int"
    return cut.select(*_PAGES, "cut").mapInArrow(_convert, schema)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = clean_pages(table(spark, folder, "page"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_kinds").alias("kinds")) for f in ("title", "text")])
    return pages.select("page_id", F.explode(fields).alias("f")).select("page_id", "f.field", F.explode("f.kinds").alias("kind"))


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_pages(table(spark, folder, "page"))


def p4_planted(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, removed, same) of pages on which a menu of their host was planted; same: the clean text is that without the menu."""
    page, menu = table(spark, folder, "page"), F.concat(F.lit('<div class="menu"><p>Home pages and contents of '), F.coalesce("file_name", F.lit("")), F.lit("</p></div>"))
    planted = clean_pages(page.withColumn("text", F.concat(menu, "text"))).select("page_id", "removed", F.col("text").alias("planted"))
    return planted.join(clean_pages(page).select("page_id", "text"), "page_id").select("page_id", "removed", F.col("text").eqNullSafe(F.col("planted")).alias("same"))


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean, "p4_planted": p4_planted}
#: The menu is two subtrees, the block and its paragraph.
SQL = {
    "p4_planted": f"""
WITH p AS (SELECT DISTINCT page_id, coalesce(file_name, '') AS host, text IS NOT NULL AS has FROM page WHERE page_id IS NOT NULL),
h AS (SELECT host, count(*) AS size, count(*) FILTER (has) AS n FROM p GROUP BY host),
r AS (SELECT page_id, has, CASE WHEN has AND n >= {FURNITURE_PAGES} AND n >= {FURNITURE_SHARE} * size THEN 2 ELSE 0 END AS removed FROM p JOIN h USING (host))
SELECT page_id, CAST(removed AS INTEGER) AS removed, removed = 2 OR NOT has AS same FROM r""",
}
