"""Bridging gaps between dead ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netresil.functions import expressions as X
from netresil.functions.geometry import curvature, gap_direction_score, norm2, unit_vector
from netresil.operators.components import connected_components, star_labels
from netresil.operators.graph import first_neighbour, terminals
from netresil.operators.raster import border_guard, focal_max, norm01
from netresil.operators.resample import sample_line
from netresil.operators.skeleton import bounded_reach, corridor_coverage, stub_vectors
from netresil.operators.spatial import distance_pairs
from netresil.session import cut_lineage

# Settings of both healing methods.
OPTICAL = {"buffer_m": 100.0, "threshold": 0.35, "los_min_prob": 0.05}
WCS = {"buffer_m": 200.0, "passes": (0.70, 0.60), "lookback": 5, "sar_dil": 2, "min_direction": 0.10, "min_width": 1.0}
LABELS = {"buffer_m": 100.0, "border_px": 5, "dilation": 3, "reach": 1.5, "yes": 0.60, "no": 0.20}


def max_spanning_bridges(candidates: DataFrame, components: DataFrame) -> DataFrame:
    """Candidates a best-first union would accept: ``ni, nj, score`` and the rest.

    Borůvka rounds: every component names its best candidate to another one
    under the total order (score down, ni, nj); those are accepted, components
    merge, and the rest is relabelled. With a total order the result is the
    maximum spanning forest, the same edges Kruskal accepts. Only the best
    candidate between two components ever travels on.
    """
    label = components.select("node_id", "component")
    order = F.struct(-F.col("score"), F.col("ni"), F.col("nj"))
    c = candidates.join(label.select(F.col("node_id").alias("ni"), F.col("component").alias("ci")), "ni").join(
        label.select(F.col("node_id").alias("nj"), F.col("component").alias("cj")), "nj"
    )
    rest = [x for x in candidates.columns if x not in ("ni", "nj", "score")]

    def thinned(df):
        two = df.where(F.col("ci") != F.col("cj")).withColumns({"a": F.least("ci", "cj"), "b": F.greatest("ci", "cj")})
        return two.groupBy("a", "b").agg(
            F.min_by(F.struct("ni", "nj", "score", *rest), order).alias("k")
        ).select(F.col("a").alias("ci"), F.col("b").alias("cj"), "k.*")

    live = cut_lineage(thinned(c))
    taken = []
    while live.limit(1).count() > 0:
        ends = live.withColumn("own", F.explode(F.array("ci", "cj")))
        best = ends.groupBy("own").agg(F.min_by(F.struct("ci", "cj", "ni", "nj", "score", *rest), order).alias("k"))
        won = cut_lineage(best.select("k.*").distinct())
        taken.append(won.drop("ci", "cj"))
        merged = star_labels(won.select(F.col("ci").alias("src"), F.col("cj").alias("dst")))
        to = lambda x: merged.select(F.col("node_id").alias(x), F.col("component").alias(f"n{x}"))  # noqa: E731,B023
        moved = live.join(to("ci"), "ci", "left").join(to("cj"), "cj", "left").withColumns(
            {"ci": F.coalesce("nci", "ci"), "cj": F.coalesce("ncj", "cj")}
        ).drop("nci", "ncj")
        live = cut_lineage(thinned(moved))
    if not taken:
        return candidates.limit(0).select("ni", "nj", "score", *rest)
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.select("ni", "nj", "score", *rest)


def rank_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.col("score").desc(), "ni", "nj")


def optical_candidates(nodes: DataFrame, edges: DataFrame, prob: DataFrame, buffer_m: float, los_min_prob: float) -> DataFrame:
    """Scored pairs of dead ends: ``ni, nj, gap, score, vetoed``.

    ``nodes(node_id, x, y, r, c)``, ``prob(r, c, value)``.
    """
    dead = nodes.join(terminals(edges), "node_id", "left_semi")
    pairs = cut_lineage(distance_pairs(dead, buffer_m))
    stub = first_neighbour(edges).join(nodes.select(F.col("node_id").alias("neighbour"), F.col("x").alias("nx"), F.col("y").alias("ny")), "neighbour")

    def end(tag):
        at = nodes.select(F.col("node_id"), "r", "c").join(stub, "node_id").select(
            F.col("node_id").alias(f"n{tag}"), F.col("nx").alias(f"sx{tag}"), F.col("ny").alias(f"sy{tag}"),
            F.col("r").alias("r1" if tag == "i" else "r2"), F.col("c").alias("c1" if tag == "i" else "c2"),
        )
        return at

    p = cut_lineage(pairs.join(end("i"), "ni").join(end("j"), "nj"))
    gx, gy = unit_vector(F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi"))
    ax, ay = unit_vector(F.col("xi") - F.col("sxi"), F.col("yi") - F.col("syi"))
    bx, by = unit_vector(F.col("xj") - F.col("sxj"), F.col("yj") - F.col("syj"))
    p = p.withColumns({"D": gap_direction_score(ax, ay, bx, by, gx, gy), "C": curvature(ax, ay, bx, by)})
    sight = sample_line(p, prob, ["ni", "nj"], interior=True)
    long = F.greatest(F.abs(F.col("r2") - F.col("r1")), F.abs(F.col("c2") - F.col("c1"))) + 1 > 2
    veto = long & (F.col("max") < los_min_prob)
    return p.join(sight, ["ni", "nj"]).select(
        "ni", "nj", "gap", "D", "C", veto.alias("vetoed"), X.heuristic_score(F.col("D"), F.col("C"), veto).alias("score")
    )


def heal_optical(nodes: DataFrame, edges: DataFrame, prob: DataFrame, buffer_m: float = OPTICAL["buffer_m"],
                 threshold: float = OPTICAL["threshold"], los_min_prob: float = OPTICAL["los_min_prob"]) -> DataFrame:
    """New edges ``src, dst, length_m, score`` that bridge gaps by geometry and sight."""
    cand = optical_candidates(nodes, edges, prob, buffer_m, los_min_prob).where(F.col("score") >= threshold)
    won = max_spanning_bridges(cand.select("ni", "nj", "score", "gap"), connected_components(nodes, edges))
    return won.select(F.col("ni").alias("src"), F.col("nj").alias("dst"), F.col("gap").alias("length_m"), "score")


def candidate_gates(c: DataFrame, threshold: float, min_direction: float = WCS["min_direction"],
                    min_width: float = WCS["min_width"], width_floor: float | None = None) -> DataFrame:
    """Cheap gates first, then the confidence score ``wcs`` and its threshold.

    ``D`` is null where a stub is missing, ``S`` where no pixel was in bounds.
    """
    W = X.width_similarity(F.col("w1"), F.col("w2"), width_floor)
    return (
        c.where(F.col("D").isNotNull() & (F.col("D") >= min_direction) & (F.col("w1") >= min_width) & (F.col("w2") >= min_width))
        .where(F.col("S").isNotNull())
        .withColumn("W", W)
        .withColumn("wcs", X.wcs(F.col("D"), F.col("S"), F.col("W"), F.col("C")))
        .where(F.col("wcs") >= threshold)
    )


def radar_corridor(vv: DataFrame, vh: DataFrame, half_width: int = WCS["sar_dil"]) -> DataFrame:
    """Stretched mean of both bands, widened: ``r, c, value``."""
    a, b = norm01(vv), norm01(vh)
    mix = a.select("r", "c", F.col("value").alias("a")).join(b.select("r", "c", F.col("value").alias("b")), ["r", "c"]).select(
        "r", "c", (0.5 * F.col("a") + 0.5 * F.col("b")).alias("value")
    )
    return focal_max(mix, 2 * half_width + 1)


def gap_features(dead: DataFrame, skel: DataFrame, widths: DataFrame, radar: DataFrame, buffer_px: float,
                 lookback: int = WCS["lookback"], min_direction: float = WCS["min_direction"]) -> DataFrame:
    """Pairs of dead ends with D, C, both widths and S.

    ``dead(node_id, r, c)``. Stubs are walked once per dead end, not per pair;
    radar is sampled only for pairs that pass the cheap gates.
    """
    ends = cut_lineage(dead.select("node_id", "r", "c"))
    stub = stub_vectors(ends.withColumnRenamed("node_id", "id"), skel, lookback)
    w = widths.select("r", "c", F.col("dist").alias("w"))
    info = cut_lineage(
        ends.join(stub, F.col("node_id") == F.col("id")).join(w, ["r", "c"], "left")
        .select("node_id", "r", "c", "ur", "uc", F.coalesce("w", F.lit(0.0)).alias("w"))
    )
    pairs = distance_pairs(ends.select("node_id", F.col("r").cast("double").alias("x"), F.col("c").cast("double").alias("y")), buffer_px)
    i = info.select(*[F.col(c).alias(a) for c, a in zip(info.columns, ("ni", "r1", "c1", "u1r", "u1c", "w1"))])
    j = info.select(*[F.col(c).alias(a) for c, a in zip(info.columns, ("nj", "r2", "c2", "u2r", "u2c", "w2"))])
    p = pairs.select("ni", "nj", "gap").join(i, "ni").join(j, "nj")
    gr, gc = unit_vector(F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1"))
    u = [F.col(x) for x in ("u1r", "u1c", "u2r", "u2c")]
    missing = F.col("u1r").isNull() | F.col("u2r").isNull()
    p = cut_lineage(p.withColumns({
        "D": F.when(~missing, gap_direction_score(*u, gr, gc)), "C": F.when(~missing, curvature(*u)),
    }))
    good = p.where(F.col("D").isNotNull() & (F.col("D") >= min_direction) & (F.col("w1") >= 1.0) & (F.col("w2") >= 1.0))
    s = sample_line(good, radar, ["ni", "nj"]).select("ni", "nj", F.when(F.col("met") > 0, F.col("mean")).alias("S"))
    return p.join(s, ["ni", "nj"], "left")


def heal_wcs(nodes: DataFrame, edges: DataFrame, features: DataFrame, threshold: float, pixel_m: float,
             components: DataFrame | None = None) -> DataFrame:
    """Bridges of one pass, ``features`` as from ``gap_features``, ``components`` those of the edges where they are known."""
    c = candidate_gates(features, threshold).select("ni", "nj", F.col("wcs").alias("score"), "gap")
    won = max_spanning_bridges(c, connected_components(nodes, edges) if components is None else components)
    return won.select(
        F.col("ni").alias("src"), F.col("nj").alias("dst"), (F.col("gap") * pixel_m).alias("length_m"), "score"
    )


def label_gaps(pairs: DataFrame, skel: DataFrame, road: DataFrame, shape: tuple[int, int],
               widths: DataFrame) -> DataFrame:
    """Every pair with its outcome and, where used, a 0/1 label.

    ``pairs`` as from ``gap_features``, ``widths(r, c, dist)``. Outcomes:
    bad_width, no_stub, geom_veto, already_connected, pos, neg, drop.
    """
    px, h, w = LABELS["border_px"], shape[0], shape[1]
    inside = lambda r, c: F.col(r).between(px, h - px - 1) & F.col(c).between(px, w - px - 1)
    ok = inside("r1", "c1") & inside("r2", "c2") & (F.col("w1") >= 1.0) & (F.col("w2") >= 1.0)
    p = cut_lineage(pairs.withColumn("pair", F.struct("ni", "nj")).withColumn(
        "outcome",
        F.when(~ok, "bad_width").when(F.col("D").isNull(), "no_stub").when(F.col("D") < WCS["min_direction"], "geom_veto"),
    ))
    open_ = p.where(F.col("outcome").isNull()).withColumn("limit", F.floor(F.col("gap") * LABELS["reach"]))
    joined = cut_lineage(bounded_reach(open_, skel))
    gaps = open_.join(joined.where(~F.col("joined")), "pair", "left_semi")
    cover = corridor_coverage(gaps, road, shape, "pair", LABELS["dilation"])
    out = p.join(joined, "pair", "left").join(cover, "pair", "left")
    kind = F.coalesce(
        "outcome",
        F.when(F.col("joined"), "already_connected").when(F.col("coverage") >= LABELS["yes"], "pos")
        .when(F.col("coverage") <= LABELS["no"], "neg").otherwise("drop"),
    )
    label = F.when(kind == "pos", 1).when(kind.isin("neg", "already_connected"), 0)
    return out.withColumn("outcome", kind).withColumn("label", label).drop("pair", "joined", "pixels")
