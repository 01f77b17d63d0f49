"""What a text or page says of a project: its name, place and sponsor, links to files, damaged keys, and a small graph.

All are expressions within a row, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.lookups import STATES, heal_key
from acervo.operators.sections import strip

# Labels beside which a text names a project, its place and its sponsor; a company's name; a year.
NAME_LABELS = r"nombre\s+del\s+proyecto|proyecto|nombre|denominación"
PLACE_LABELS = "ubicación|estado|municipio|localidad"
SPONSOR_LABELS = "promovente|empresa|interesado|peticionario|responsable"
COMPANY = r"([A-Z][A-Za-z0-9\s,.]+ S\.A\.(?: de C\.V\.)?)"
YEAR = r"20\d{2}"

_URL = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def key_context(text: Column, key: Column, most: int = 200) -> Column:
    """struct<name, place, sponsor> from the first line that holds the key in any case; null where the text names none.

    A table row gives its longest cells of 4 characters or more that are no numbers: the longest is the name, the next the
    place, the first of equals first; the cell with the key is no candidate. Any other line gives labelled values of the
    lines from three above to three below; values of 3 characters or fewer count as none. Longer names end in dots.
    """
    wanted = F.upper(key)
    holds = lambda s: F.contains(F.upper(s), wanted)
    colon = r"\s*:\s*"

    def context(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, holds), F.lit(True)).cast("int")
        first = F.greatest(at - 3, F.lit(1))
        line = F.try_element_at(lines, F.nullif(at, F.lit(0)))
        return F.struct(line.alias("line"), F.array_join(F.slice(lines, first, F.greatest(at + 4 - first, F.lit(0))), "\n").alias("around"))

    def ranked(line: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(line, r"^\s*\||\|\s*$", ""), r"\|", -1), strip)
        return _let(F.struct(cells.alias("cells"), F.array_position(F.transform(cells, holds), F.lit(True)).alias("own")), lambda s: F.transform(F.array_sort(F.filter(F.transform(s["cells"], lambda c, i: F.struct((-F.length(c)).alias("n"), i.alias("i"), c.alias("c"))), lambda x: (x["i"] != s["own"] - 1) & (F.length(x["c"]) >= 4) & ~x["c"].rlike(r"^\d+$"))), lambda x: x["c"]))

    def value(around: Column, labels: str, sign: str = colon) -> Column:
        found = F.regexp_replace(strip(F.regexp_extract(around, rf"(?iu)(?:{labels}){sign}([^\n|]+)", 1)), "[*`_#]+", "")
        return _let(found, lambda f: F.when(F.length(f) > 3, f))

    def values(c: Column) -> Column:
        around, none = c["around"], F.lit(None).cast("string")
        beside = F.array(F.coalesce(value(around, NAME_LABELS), value(around, NAME_LABELS, r"\s+is\s+")), value(around, PLACE_LABELS), value(around, SPONSOR_LABELS))
        row = _let(ranked(c["line"]), lambda r: F.array(F.try_element_at(r, F.lit(1)), F.try_element_at(r, F.lit(2)), none))
        return F.when(c["line"].contains("|"), row).when(c["line"].isNotNull(), beside)

    def clean(found: Column) -> Column:
        name, place, sponsor = (F.nullif(F.btrim(strip(F.get(found, i)), F.lit("\"'[]()")), F.lit("")) for i in range(3))
        short = _let(name, lambda n: F.when(F.length(n) > most, F.concat(F.substring(n, 1, most - 3), F.lit("..."))).otherwise(n))
        return F.struct(short.alias("name"), place.alias("place"), sponsor.alias("sponsor"))

    return _let(_let(_let(F.split(F.coalesce(text, F.lit("")), "\n", -1), context), values), clean)


def healed_keys(text: Column) -> Column:
    """array<string>: every run of 13 letters and digits, from left to right without overlap, that can be put right as a key."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9]{13}"), F.lit(0))
    return F.array_compact(F.transform(runs, lambda r: heal_key(F.upper(r))))


def _without_dots(path: Column) -> Column:
    """An absolute path without its . and .. parts; more .. than parts stop at the root."""

    def step(have: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(1)))).when(part == ".", have).otherwise(F.concat(have, F.array(part)))

    parts = F.split(F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/"), "/", -1)
    return F.array_join(_let(parts, lambda p: F.aggregate(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1), step)), "/")


def resolve_url(base: Column, reference: Column) -> Column:
    """The absolute form of a reference on a page with an absolute url, by RFC 3986; null if either is null."""
    parts = lambda url: F.struct(*[F.regexp_extract(url, _URL, n).alias(name) for name, n in (("scheme", 1), ("host", 3), ("path", 5), ("query", 6), ("mark", 8))])

    def joined(s: Column) -> Column:
        b, r = s["b"], s["r"]
        own = (r["scheme"] != "") | (r["host"] != "")
        same = ~own & (r["path"] == "")
        folder = F.when((b["host"] != "") & (b["path"] == ""), "/").otherwise(F.regexp_replace(b["path"], r"[^/]*$", ""))
        whole = F.when(own | r["path"].startswith("/"), r["path"]).otherwise(F.concat(folder, r["path"]))
        path = F.when(same, b["path"]).otherwise(_let(whole, lambda w: F.when(w.startswith("/"), _without_dots(w)).otherwise(w)))
        query = F.when(same & (r["query"] == ""), b["query"]).otherwise(r["query"])
        return F.concat(F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"]), F.when(own, r["host"]).otherwise(b["host"]), path, query, r["mark"])

    return F.when(base.isNotNull() & reference.isNotNull(), _let(F.struct(parts(base).alias("b"), parts(strip(reference)).alias("r")), joined))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value of any quoting, or null where the tag lacks it."""
    pattern = rf"""(?is)(?:^|[\s"']){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tag.rlike(pattern), F.replace(F.concat(*[F.regexp_extract(tag, pattern, n) for n in (1, 2, 3)]), F.lit("&amp;"), F.lit("&")))


def _label(inner: Column) -> Column:
    """The text between tags, each piece without white space at its ends."""
    return F.replace(F.array_join(F.transform(F.split(inner, "<[^>]*>", -1), strip), ""), F.lit("&amp;"), F.lit("&"))


def file_links(pages: DataFrame, key: str, html: str, url: str, words: tuple[str, ...] = ("gaceta", "archivos"), year: int | None = None, suffix: str = ".pdf") -> DataFrame:
    """(key, place, attribute, url, filename, label, year): links of a page to files, made absolute.

    Anchors count whose href holds the suffix and one of the words (any, if there are none), then elements of any kind whose
    data-href holds the suffix, all in any case. The year is the first of this century in the label, else in the link; rows
    of other years go where one is given. Null pages have no links; a null url leaves null. A tag ends at its first >.
    """
    def found(attribute: str, tags: str, ends: Column, wanted: tuple[str, ...]) -> Column:
        cut = F.split(F.concat(F.lit(" "), F.coalesce(F.col(html), F.lit(""))), tags, -1)
        opened = F.filter(F.slice(cut, 2, F.size(cut)), lambda p: p.contains(">"))
        found_ = F.transform(opened, lambda p: F.struct(F.lit(attribute).alias("attribute"), _attribute(F.substring_index(p, ">", 1), attribute).alias("href"), p.alias("rest")))
        low = lambda s: F.lower(s["href"])
        keep = lambda s: F.coalesce(low(s).contains(suffix) & (F.lit(not wanted) | F.array_contains(F.transform(F.array(*[F.lit(w) for w in wanted or ("",)]), lambda w: F.contains(low(s), w)), True)), F.lit(False))
        return F.transform(F.filter(found_, keep), lambda s: F.struct(s["attribute"].alias("attribute"), s["href"].alias("href"), _label(F.element_at(F.split(F.regexp_replace(s["rest"], r"^[^>]*>", ""), ends, 2), 1)).alias("label")))

    anchors = found("href", r"(?i)<a(?=\s)", F.lit("(?i)</a"), words)
    others = found("data-href", r"(?i)(?=<[a-z][a-z0-9]*\s[^<>]*data-href)", F.lit("</"), ())
    rows = pages.select(key, F.col(url).alias("_base"), F.posexplode(F.concat(anchors, others)).alias("place", "_l")).select(key, "place", "_base", "_l.*")
    dated = F.coalesce(*[F.nullif(F.regexp_extract(c, YEAR, 0), F.lit("")) for c in ("label", "href")]).cast("int")
    out = rows.select(key, "place", "attribute", resolve_url(F.col("_base"), F.col("href")).alias("url"), F.regexp_extract(F.rtrim(F.col("href"), F.lit("/")), r"[^/]*$", 0).alias("filename"), "label", dated.alias("year"))
    return out if year is None else out.where(F.col("year") == year)


def text_graph(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nodes array<struct<id, label, type>>, relations array<struct<src, dst, relation>>) where no model has read a text.

    The first key gives a project and, for a known code, its state; the first company gives a sponsor. A text with
    neither, or null, gives two empty arrays.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    code = F.nullif(F.regexp_extract(t, r"\b\d{2}[A-Z]{2}\d{4}[A-Z]\d{4}\b", 0), F.lit(""))
    # A name lies within one run of its characters, so runs are searched apart and the search stays linear.
    runs = F.filter(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9\s,.]+"), F.lit(0)), lambda r: r.contains(" S.A."))
    company = F.try_element_at(F.filter(F.transform(runs, lambda r: strip(F.regexp_extract(r, COMPANY, 1))), lambda c: c != ""), F.lit(1))
    node = lambda i, label, kind: F.when(i.isNotNull(), F.struct(i.alias("id"), label.alias("label"), F.lit(kind).alias("type")))

    def graph(s: Column) -> Column:
        place = F.when(s["state"].isNotNull(), F.concat(F.lit("ESTADO_"), F.substring(s["code"], 3, 2)))
        sponsor = F.replace(F.replace(F.upper(s["company"]), F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))
        edge = lambda b, r: F.when(s["code"].isNotNull() & b.isNotNull(), F.struct(s["code"].alias("src"), b.alias("dst"), F.lit(r).alias("relation")))
        nodes = F.array(node(s["code"], F.concat(F.lit("Proyecto "), s["code"]), "proyecto"), node(place, s["state"], "estado"), node(sponsor, s["company"], "promovente"))
        return F.struct(F.array_compact(nodes).alias("nodes"), F.array_compact(F.array(edge(place, "UBICADO_EN"), edge(sponsor, "PRESENTADO_POR"))).alias("relations"))

    facts = F.struct(code.alias("code"), F.try_element_at(names, F.substring(code, 3, 2)).alias("state"), company.alias("company"))
    return docs.select(key, _let(facts, graph).alias("_g")).select(key, "_g.nodes", "_g.relations")


def text_graph_nodes(found: DataFrame) -> DataFrame:
    """(id, type, label, n): each node of text_graph once, with the least of its labels and the texts that name it."""
    return found.select(F.explode("nodes").alias("_n")).select("_n.*").groupBy("id", "type").agg(F.min("label").alias("label"), F.count("*").alias("n"))


def text_graph_edges(found: DataFrame) -> DataFrame:
    """(src, dst, relation, weight): 1 for the first text that names a relation and 0.1 for each one more."""
    return found.select(F.explode("relations").alias("_r")).select("_r.*").groupBy("src", "dst", "relation").agg(F.round(1.0 + 0.1 * (F.count("*") - 1), 4).alias("weight"))
