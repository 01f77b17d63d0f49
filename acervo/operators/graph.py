"""Entity graphs as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.scratch import kept
from acervo.operators.keys import parse_key
from acervo.operators.numbering import numbered

# Types of nodes of the project graph in the order of their numbers, with the colours they are drawn in.
NODE_COLORS = {
    "proyecto": "#FFB000", "estado": "#27AE60", "tipo_mia": "#9B59B6", "año": "#3498DB", "sector": "#E67E22",
    "promovente": "#E84393", "municipio": "#5DADE2",
}
#: Types whose nodes come from codes of a few characters, so that their number is bounded whatever the projects are.
CODED = ("estado", "tipo_mia", "año", "sector")


def project_edges(projects: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, relation) of valid projects (clave, state, municipality, sponsor, kind, key_year, sector).

    With columns to keep, these come first, then `place`, the edge's place among those of its project.
    """
    town = F.when(F.trim("municipality") != "", F.concat(F.lit("muni_"), F.col("state"), F.lit("_"), F.upper("municipality")))
    state = F.concat(F.lit("state_"), F.col("state"))
    edge = lambda a, b, r: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("src"), b.alias("dst"), F.lit(r).alias("relation")))
    key = F.col("clave")
    edges = F.array_compact(F.array(
        F.coalesce(edge(key, town, "UBICADO_EN"), edge(key, state, "UBICADO_EN")), edge(town, state, "PERTENECE_A"),
        edge(key, F.concat(F.lit("prom_"), F.upper("sponsor")), "PROMOVIDO_POR"), edge(key, F.concat(F.lit("type_"), F.col("kind")), "ES_TIPO"),
        edge(key, F.concat(F.lit("year_"), F.col("key_year")), "DEL_AÑO"), edge(key, F.concat(F.lit("sector_"), F.col("sector")), "DEL_SECTOR"),
    ))
    if keep:
        return projects.select(*keep, F.posexplode(edges).alias("place", "e")).select(*keep, "place", "e.*")
    return projects.select(F.explode(edges).alias("e")).select("e.*")


def project_nodes(projects: DataFrame, order: str) -> DataFrame:
    """(id, type, label, year, project_name, verdict, seen, place) of valid projects, the columns of project_edges and state_name, kind_name,
    project_name, verdict: each node once, as the first project by `order` (no two alike) names it. seen and place tell where."""
    text = lambda c: F.lit(None).cast("string") if c is None else c
    node = lambda i, kind, label, year=None, name=None, verdict=None: F.when(i.isNotNull() & (label.isNotNull()), F.struct(i.alias("id"), F.lit(kind).alias("type"), label.alias("label"), (F.lit(None) if year is None else year).cast("int").alias("year"), text(name).alias("project_name"), text(verdict).alias("verdict")))
    key, year = F.col("clave"), F.col("key_year")
    town = F.when(F.trim("municipality") != "", F.concat(F.lit("muni_"), F.col("state"), F.lit("_"), F.upper("municipality")))
    nodes = F.array(
        node(key, "proyecto", key, year, F.coalesce("project_name", F.concat(F.lit("Proyecto "), key)), F.col("verdict")),
        node(F.concat(F.lit("state_"), F.col("state")), "estado", F.coalesce("state_name", "state")), node(town, "municipio", F.trim("municipality")),
        node(F.concat(F.lit("prom_"), F.upper("sponsor")), "promovente", F.trim("sponsor")), node(F.concat(F.lit("type_"), F.col("kind")), "tipo_mia", F.coalesce("kind_name", "kind")),
        node(F.concat(F.lit("year_"), year), "año", year.cast("string")), node(F.concat(F.lit("sector_"), F.col("sector")), "sector", F.concat(F.lit("Sector "), F.col("sector"))),
    )
    rows = projects.select(F.col(order).alias("seen"), F.posexplode(nodes).alias("place", "n")).where("n IS NOT NULL")
    first = rows.groupBy("n.id").agg(F.min_by("n", F.struct("seen", "place")).alias("n"), F.min(F.struct("seen", "place")).alias("at"))
    return first.select("n.*", "at.*")


def encode(nodes: DataFrame, edges: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, links and relations of a graph by dense numbers in first-seen order, from project_nodes and project_edges with `order` kept.

    (index, id, type, label, color, year, degree, community, project_name, verdict), (src_index, dst_index, relation_index) and
    (relation_index, relation). Ends without a node give no link. Nodes that many links share come from codes and are broadcast;
    their number is bounded. Other ends are joined by name.
    """
    edges = kept(edges)
    types = F.create_map(*[F.lit(x) for i, t in enumerate(NODE_COLORS) for x in (t, i)])
    colors = F.create_map(*[F.lit(x) for pair in NODE_COLORS.items() for x in pair])
    counted = numbered(nodes, ["seen", "place"], "index").join(_ends(edges).withColumnRenamed("node", "id"), "id", "left")
    out = kept(counted.select("index", "id", "type", "label", F.coalesce(F.try_element_at(colors, "type"), F.lit("#AAAAAA")).alias("color"), "year", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce(F.try_element_at(types, "type"), F.lit(0)).alias("community"), "project_name", "verdict"))
    kinds = edges.groupBy("relation").agg(F.min(F.struct(order, "place")).alias("_at"))
    kinds = kept(numbered(kinds.select("relation", "_at.*"), [order, "place"], "relation_index").select("relation_index", "relation"))
    number = lambda end, where: out.where(where).select(F.col("id").alias(end), F.col("index").alias(f"{end}_index"))
    coded = F.col("type").isin(*CODED)
    rows = edges.join(number("src", F.lit(True)), "src").join(F.broadcast(number("dst", coded)), "dst", "left")
    near = rows.where("dst_index IS NOT NULL")
    far = rows.where("dst_index IS NULL").drop("dst_index").join(number("dst", ~coded), "dst")
    links = near.select(*far.columns).unionByName(far).join(F.broadcast(kinds), "relation")
    return out, links.select("src_index", "dst_index", "relation_index"), kinds


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): ends of edges by node, and their share of the largest degree."""
    ends = kept(_ends(edges))
    return ends.crossJoin(F.broadcast(ends.agg(F.max("degree").alias("_top")))).select("node", "degree", F.round(F.col("degree") / F.col("_top"), 6).alias("centrality"))


def metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and mean degree; each edge has two ends."""
    return _ends(edges).agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 2).alias("mean_degree"), F.coalesce((F.sum("degree") / 2).cast("long"), F.lit(0).cast("long")).alias("edges"))


def compact(edges: DataFrame) -> DataFrame:
    """(src_index, dst_index, relation_index): dense numbers by name. The edges are written once and read for names and links."""
    edges = kept(edges)
    number = _dense(edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct())
    kind = _dense(edges.select(F.col("relation").alias("name")).distinct()).select(F.col("name").alias("relation"), F.col("index").alias("relation_index"))
    out = edges.join(number.select(F.col("name").alias("src"), F.col("index").alias("src_index")), "src").join(number.select(F.col("name").alias("dst"), F.col("index").alias("dst_index")), "dst")
    return out.join(kind, "relation").select("src_index", "dst_index", "relation_index")


def _dense(names: DataFrame) -> DataFrame:
    """(name, index from 0 by name) of distinct names: a place within a range of names, behind the names of the ranges before.

    Ranges follow samples of the names, so common prefixes don't matter; only one row a range meets in the running sum.
    """
    placed = kept(names.select("name").repartitionByRange("name").sortWithinPartitions("name").withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.select("name", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(2**33 - 1).alias("_i"))
    ranges = placed.groupBy("_p").count()
    before = ranges.select("_p", (F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")).alias("_b"))
    return placed.join(F.broadcast(before), "_p").select("name", (F.col("_b") + F.col("_i")).cast("long").alias("index"))


def merge(old_nodes: DataFrame, old_edges: DataFrame, nodes: DataFrame, edges: DataFrame, renames: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes with new ids are added; edges with renamed relations are added when new and both ends exist."""
    all_nodes = old_nodes.unionByName(nodes.join(old_nodes.select("id"), "id", "left_anti").dropDuplicates(["id"]))
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in renames.items() for x in p]), "relation"), "relation")
    fresh = edges.withColumn("relation", name).distinct().join(old_edges, ["src", "dst", "relation"], "left_anti")
    for end in ("src", "dst"):
        fresh = fresh.join(all_nodes.select(F.col("id").alias(end)), end, "left_semi")
    return all_nodes, old_edges.unionByName(fresh)


def one_hop(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, way, relation, other): distinct neighbours of the wanted nodes, along and against the edges."""
    both = edges.select(F.col("src").alias("id"), F.lit("out").alias("way"), "relation", F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.lit("in").alias("way"), "relation", F.col("src").alias("other")))
    return both.join(wanted.select("id").distinct(), "id", "left_semi").distinct()


def one_hop_or_key(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """one_hop, and for wanted ids without an edge that are well-formed keys the four relations that a key tells: state, type, sector and year.

    Null ids and ids with neither edges nor a key's form give no row.
    """
    near = one_hop(edges, wanted)
    told = lambda relation, c: F.struct(F.lit(relation).alias("relation"), c.cast("string").alias("other"))
    alone = parse_key(wanted.select("id").where("id IS NOT NULL").distinct().join(_ends(edges).select(F.col("node").alias("id")), "id", "left_anti"), "id").where("valid")
    relations = F.array(told("UBICADO_EN", F.col("state_name")), told("ES_TIPO", F.col("kind_name")), told("DEL_SECTOR", F.concat(F.lit("Sector "), F.col("sector"))), told("DEL_AÑO", F.col("key_year")))
    return near.unionByName(alone.select("id", F.lit("key").alias("way"), F.explode(relations).alias("r")).select("id", "way", "r.*"))


def components(nodes: DataFrame, edges: DataFrame, shared: str | None = None) -> DataFrame:
    """(id, community): connected nodes share a number, counted from 0 by their smallest id; all nodes of type `shared` get one more.

    nodes (id, type) and edges (src, dst); edges at shared or unknown nodes connect nothing. Each round takes the
    neighbours' smallest label, then that label's own label, so long chains take few rounds; checkpoints cut the lineage.
    """
    own = nodes.where(~F.col("type").eqNullSafe(shared) | F.lit(shared is None)).select("id").distinct()
    ends = edges.select("src", "dst").where("src <> dst").join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi")
    both = kept(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = kept(own.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(labels, both.dst == labels.id).groupBy(F.col("src").alias("id")).agg(F.min("label").alias("_near"))
        lower = labels.join(near, "id", "left").select("id", F.col("label").alias("_old"), F.least("label", F.coalesce("_near", "label")).alias("label"))
        above = labels.select(F.col("id").alias("label"), F.col("label").alias("_up"))
        new = kept(lower.join(above, "label").select("id", "_old", F.least("label", "_up").alias("label")))
        labels = new.select("id", "label")
        if new.where("label <> _old").isEmpty():
            break
    numbers = _dense(labels.select(F.col("label").alias("name")).distinct())
    out = labels.join(numbers, labels.label == numbers.name).select("id", F.col("index").alias("community"))
    if shared is None:
        return out
    extra = F.broadcast(numbers.agg(F.count("*").alias("community")))
    return out.unionByName(nodes.where(F.col("type") == shared).select("id").distinct().crossJoin(extra))


def search(nodes: DataFrame, words: str, most: int = 15) -> DataFrame:
    """(node, degree): nodes whose name holds the words in any case, by degree."""
    return nodes.where(F.contains(F.lower("node"), F.lit(words.lower()))).orderBy(F.desc("degree"), "node").limit(most).select("node", "degree")


def borders(cells: DataFrame, x: str, y: str) -> DataFrame:
    """(ax, ay, bx, by): touching cells of a grid, each pair once. Each cell names four of its neighbours, which are joined by equality."""
    cell = cells.select(F.col(x).alias("ax"), F.col(y).alias("ay")).distinct()
    around = F.explode(F.array(*[F.struct((F.col("ax") + i).alias("bx"), (F.col("ay") + j).alias("by")) for i, j in ((1, -1), (1, 0), (1, 1), (0, 1))]))
    return cell.select("ax", "ay", around.alias("_b")).select("ax", "ay", "_b.bx", "_b.by").join(cell.select(F.col("ax").alias("bx"), F.col("ay").alias("by")), ["bx", "by"])


def maritime(encounters: DataFrame, borders_: DataFrame, permits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of encounters (event, vessel, cell, species), bordering cells (a, b) and permits (vessel, permit).

    Nodes are (id, type), edges (src, dst, relation), each once; permits of vessels that no encounter names are left out.
    """
    name = lambda kind, c: F.concat(F.lit(f"{kind}_"), F.regexp_replace(F.lower(F.col(c).cast("string")), " ", "_"))
    vessel, cell, event, species = name("vessel", "vessel"), name("cell", "cell"), name("event", "event"), name("species", "species")
    edge = lambda a, b, r: F.struct(a.alias("src"), b.alias("dst"), F.lit(r).alias("relation"))
    seen = encounters.select(F.explode(F.array(edge(vessel, cell, "DETECTED_IN"), edge(vessel, event, "ENCOUNTERED"), edge(event, species, "ENCOUNTERED"))).alias("e")).select("e.*").where("src IS NOT NULL AND dst IS NOT NULL")
    touch = borders_.select(name("cell", "a").alias("src"), name("cell", "b").alias("dst"), F.lit("BORDERS").alias("relation"))
    held = permits.join(encounters.select("vessel").distinct(), "vessel", "left_semi").select(vessel.alias("src"), name("permit", "permit").alias("dst"), F.lit("HAS_PERMIT").alias("relation"))
    edges = seen.unionByName(touch).unionByName(held).distinct()
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ids.select("id", F.split_part("id", F.lit("_"), F.lit(1)).alias("type")), edges


def note_edges(links: DataFrame, key: str, target: str) -> DataFrame:
    """(src, dst, relation, weight) of notes' links: ids in upper case with _ for other signs; repeats add 0.1."""
    plain = F.regexp_replace(F.upper(F.split_part(F.col(target), F.lit("|"), F.lit(1))), r"[^\p{L}\p{N}]+", "_")
    rows = links.select(F.concat(F.lit("PROYECTO_"), F.upper(key)).alias("src"), plain.alias("dst"), F.lit("VINCULADO_A").alias("relation"))
    return rows.groupBy("src", "dst", "relation").agg(F.round(1.0 + 0.1 * (F.count("*") - 1), 4).alias("weight"))
