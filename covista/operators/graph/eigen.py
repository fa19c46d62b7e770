"""Communities by the leading eigenvector of the modularity matrix.

Starting from the connected components, a community g is split by the signs of the leading eigenvector of

    B(g)_ij = A_ij / 2m − k_i k_j / (2m)² − δ_ij Σ_{l∈g} (A_il / 2m − k_i k_l / (2m)²)

(Newman 2006) if the split raises modularity, and its parts are tried again; the method ends when no
community has such a split.  All communities of all graphs are worked on in the same jobs.

B(g) is never formed.  A product with it is a join of the edges inside communities with the vector, a sum
per vertex, and a rank-one term from one sum per community.  Its rows add up to 0, so the vectors stay
orthogonal to the constant one.  The eigenvector is found by conjugate directions: from a vector x and a
direction p the next x is the one of the largest Rayleigh quotient in their span (a quadratic equation
per community), and the next direction is its residual plus a share of p.  That takes one product a
step, as power iteration does, and far fewer steps.  A community stops when its residual is below
``TOL`` of a bound of its spectrum.  All sums are combined before the shuffle, and a table per community
goes back to the vertices, so one community with most of a graph is no hot group.

That is the way of communities with more than ``task_rows`` inner edges (both directions counted).  Smaller
ones, whose size is thus bounded, are split to the end in one task each, by the same iteration on arrays:
a level then costs one job instead of a few dozen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...runtime import KEY, cut_lineage, drop_table
from .core import as_membership, connected_components, directed, simplify, vertices, with_int_weight

TOL = 3e-3           # residual of an eigenvector, as a share of the bound of the community's spectrum
GAIN = 1e-12         # a split counts from this gain of modularity on
LEAST = 1e-300       # in place of the norm of an empty vector
TASK_ROWS = 1 << 19  # inner rows of a community that one task splits: 20 MB of arrays
TASK_TOL = 1e-5      # the residual there
SAFETY = 10_000      # steps and levels; reaching it raises


def shares(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Both directions of the simplified edges of positive weight, as shares of 2m: ``keys + [v, u, w]``."""
    e = with_int_weight(simplify(edges, keys), keys).filter(F.col("w") > 0)
    total = e.groupBy(*keys).agg((F.sum("w").cast("double") * 2).alias("m2"))
    return cut_lineage(directed(e.join(total, keys).withColumn("w", F.col("w") / F.col("m2")), keys, ["w"]), "rows")


def inner(rows: DataFrame, label: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose two ends are in one community: ``keys + [v, u, w]``; ``label`` is keys + [v, c]."""
    end = lambda v, c: label.select(*keys, F.col("v").alias(v), F.col("c").alias(c))
    return (rows.join(end("v", "c"), [*keys, "v"]).join(end("u", "cu"), [*keys, "u"])
                .filter(F.col("c") == F.col("cu")).select(*keys, "v", "u", "w"))


def operator(within: DataFrame, label: DataFrame, keys: list[str]) -> DataFrame:
    """What a product with B(g) needs of the vertices: ``keys + [v, c, k, d]`` with the strength and the
    diagonal term; ``label`` is keys + [v, c, k]."""
    total = label.groupBy(*keys, "c").agg(F.sum("k").alias("kc"))
    inside = within.groupBy(*keys, "v").agg(F.sum("w").alias("kin"))
    return (label.join(inside, [*keys, "v"], "left").join(total, [*keys, "c"])
                 .select(*keys, "v", "c", "k", (F.coalesce("kin", F.lit(0.0)) - F.col("k") * F.col("kc")).alias("d")))


def linked(within: DataFrame, state: DataFrame, keys: list[str], col: str) -> DataFrame:
    """``state`` with ``q``: the link and diagonal terms of the product of B(g) with ``col``; the
    rank-one term ``- k * sum(k * col)`` is left to add."""
    other = state.select(*keys, F.col("v").alias("u"), F.col(col).alias("_x"))
    lin = within.join(other, [*keys, "u"]).groupBy(*keys, "v").agg(F.sum(F.col("w") * F.col("_x")).alias("_lin"))
    return (state.join(lin, [*keys, "v"], "left")
                 .withColumn("q", F.coalesce("_lin", F.lit(0.0)) - F.col("d") * F.col(col)).drop("_lin"))


def modularity_product(edges: DataFrame, label: DataFrame, vector: DataFrame, keys: list[str] = [KEY]) -> DataFrame:
    """``keys + [v, y]``: B(g) times a vector (keys + [v, x]) for the communities ``label`` (keys + [v, c])."""
    rows = shares(edges, keys)
    named = rows.groupBy(*keys, "v").agg(F.sum("w").alias("k")).join(label, [*keys, "v"])
    within = inner(rows, named, keys)
    state = cut_lineage(linked(within, operator(within, named, keys).join(vector, [*keys, "v"]), keys, "x"), "step")
    sums = state.groupBy(*keys, "c").agg(F.sum(F.col("k") * F.col("x")).alias("kx"))
    return state.join(sums, [*keys, "c"]).select(*keys, "v", (F.col("q") - F.col("k") * F.col("kx")).alias("y"))


def _with_best_step(sums: DataFrame) -> DataFrame:
    """``sums`` with ``t``, which maximises the Rayleigh quotient of x + t p, and that vector's squared
    norm ``size`` and product ``top``."""
    col = F.col
    size = lambda t: F.greatest(col("xx") + 2 * col("xp") * t + col("pp") * t * t, F.lit(LEAST))
    top = lambda t: col("xmx") + 2 * col("xmp") * t + col("pmp") * t * t
    out = (sums.withColumn("_a", col("pmp") * col("xp") - col("xmp") * col("pp"))
               .withColumn("_b", col("pmp") * col("xx") - col("xmx") * col("pp"))
               .withColumn("_c", col("xmp") * col("xx") - col("xmx") * col("xp"))
               .withColumn("_r", F.sqrt(F.greatest(col("_b") * col("_b") - 4 * col("_a") * col("_c"), F.lit(0.0))))
               # both roots without cancellation: q / a and c / q
               .withColumn("_q", -(col("_b") + F.when(col("_b") < 0, -col("_r")).otherwise(col("_r"))) / 2)
               .withColumn("_t", F.coalesce(F.when(col("_a") != 0, col("_q") / col("_a")), F.lit(0.0)))
               .withColumn("_u", F.coalesce(F.when(col("_q") != 0, col("_c") / col("_q")), F.lit(0.0))))
    better = top(col("_t")) * size(col("_u")) >= top(col("_u")) * size(col("_t"))
    out = out.withColumn("t", F.when(col("pp") > 0, F.when(better, col("_t")).otherwise(col("_u"))).otherwise(F.lit(0.0)))
    return out.withColumn("size", size(col("t"))).withColumn("top", top(col("t"))).drop("_a", "_b", "_c", "_r", "_q", "_t", "_u")


def _start(v: Column) -> Column:
    """A number in (-1, 1) for each vertex."""
    return F.pmod(F.xxhash64(v), F.lit(2_000_003)).cast("double") / 1_000_001.5 - 1.0


def leading_vectors(within: DataFrame, label: DataFrame, keys: list[str]) -> DataFrame:
    """``keys + [v, c, k, x, theta]``: the leading eigenvector and eigenvalue of every community of
    ``label`` (keys + [v, c, k]) over its inner rows."""
    ck = [*keys, "c"]
    base = operator(within, label, keys).withColumn("x", _start(F.col("v")))
    mean = base.groupBy(*ck).agg(F.avg("x").alias("mean"), F.max(F.abs("d") + 2 * F.col("k")).alias("bound"))
    base = cut_lineage(base.join(mean, ck).withColumn("x", F.col("x") - F.col("mean")).drop("mean"), "start")
    state = linked(within, base, keys, "x")
    sums = state.groupBy(*ck).agg(F.sum(F.col("k") * F.col("x")).alias("kx"), F.sum(F.col("x") * F.col("x")).alias("xx"),
                                  F.sum(F.col("x") * F.col("q")).alias("xq"))
    norm = F.sqrt(F.greatest("xx", F.lit(LEAST)))
    state = (state.join(sums, ck).withColumn("theta", (F.col("xq") - F.col("kx") * F.col("kx")) / F.greatest("xx", F.lit(LEAST)))
                  .withColumn("mx", (F.col("q") - F.col("k") * F.col("kx")) / norm).withColumn("x", F.col("x") / norm)
                  .withColumn("p", F.col("mx") - F.col("theta") * F.col("x"))
                  .select(*keys, "v", "c", "k", "d", "bound", "x", "mx", "p", "theta", F.lit(None).cast("double").alias("rr"),
                          F.lit(False).alias("done")))
    state = cut_lineage(state, "vector")
    drop_table(base)
    for _ in range(SAFETY):
        stepped = cut_lineage(linked(within, state, keys, "p"), "step")
        dot = lambda a, b: F.sum(F.col(a) * F.col(b))
        sums = stepped.groupBy(*ck).agg(
            dot("x", "mx").alias("xmx"), dot("mx", "p").alias("xmp"), dot("x", "x").alias("xx"), dot("x", "p").alias("xp"),
            dot("p", "p").alias("pp"), dot("k", "p").alias("kp"), dot("p", "q").alias("pq"), dot("q", "q").alias("qq"),
            dot("k", "q").alias("kq"), dot("k", "k").alias("kk"), dot("mx", "q").alias("mq"), dot("mx", "k").alias("mk"),
            dot("mx", "mx").alias("mm"), F.first("rr").alias("old"), F.first("bound").alias("limit"))
        # the first direction is the residual, so its square is the first residual's
        sums = sums.withColumn("pmp", F.col("pq") - F.col("kp") * F.col("kp")).withColumn("old", F.coalesce("old", "pp"))
        sums = _with_best_step(sums).withColumn("new", F.col("top") / F.col("size"))
        t = F.col("t")
        mp_mp = F.col("qq") - 2 * F.col("kp") * F.col("kq") + F.col("kp") * F.col("kp") * F.col("kk")
        mx_mp = F.col("mq") - F.col("kp") * F.col("mk")
        square = ((F.col("mm") + 2 * t * mx_mp + t * t * mp_mp) / F.col("size")) - F.col("new") * F.col("new")
        sums = sums.withColumn("left", F.greatest(square, F.lit(0.0)))
        ends = (F.col("left") <= F.pow(F.lit(TOL) * F.col("limit"), F.lit(2.0))) | (F.col("pp") <= 0)
        back = sums.select(*ck, "t", "kp", F.col("new").alias("nt"), F.sqrt("size").alias("s"), F.col("left").alias("nr"),
                           F.when(F.col("old") > 0, F.col("left") / F.col("old")).otherwise(F.lit(0.0)).alias("beta"),
                           ends.alias("end"))
        mp = F.col("q") - F.col("k") * F.col("kp")
        new = (stepped.join(back, ck).withColumn("x", (F.col("x") + F.col("t") * F.col("p")) / F.col("s"))
                      .withColumn("mx", (F.col("mx") + F.col("t") * mp) / F.col("s"))
                      .withColumn("p", F.when(F.col("end"), F.lit(0.0)).otherwise(
                          F.col("mx") - F.col("nt") * F.col("x") + F.col("beta") * F.col("p")))
                      .select(*keys, "v", "c", "k", "d", "bound", "x", "mx", "p", F.col("nt").alias("theta"),
                              F.col("nr").alias("rr"), F.col("end").alias("done")))
        new = cut_lineage(new, "vector")
        drop_table(stepped)
        drop_table(state)
        state = new
        if state.filter(~F.col("done")).isEmpty():
            return state.select(*keys, "v", "c", "k", "x", "theta")
    raise RuntimeError("leading eigenvector did not converge")


def split_gains(within: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """``keys + [c, theta, gain]``: the gain of modularity of the split by signs, of communities with two signs."""
    side = vectors.select(*keys, "v", "c", "k", "theta", (F.col("x") > 0).alias("plus"))
    ends = (within.join(side.select(*keys, "v", "c", "plus"), [*keys, "v"])
                  .join(side.select(*keys, F.col("v").alias("u"), F.col("plus").alias("other")), [*keys, "u"]))
    cut = ends.filter(F.col("plus") & ~F.col("other")).groupBy(*keys, "c").agg(F.sum("w").alias("cut"))
    on = lambda cond: F.sum(F.when(cond, F.col("k")).otherwise(F.lit(0.0)))
    strength = side.groupBy(*keys, "c").agg(on(F.col("plus")).alias("kp"), on(~F.col("plus")).alias("km"),
                                            F.first("theta").alias("theta"))
    return (strength.filter((F.col("kp") > 0) & (F.col("km") > 0)).join(cut, [*keys, "c"], "left")
                    .select(*keys, "c", "theta", (2 * (F.col("kp") * F.col("km") - F.coalesce("cut", F.lit(0.0)))).alias("gain")))


def possible_splits(edges: DataFrame, membership: DataFrame, keys: list[str] = [KEY], label: str = "cluster") -> DataFrame:
    """``keys + [c]``: clusters that a split by their leading eigenvector would still improve."""
    rows = shares(edges, keys)
    named = (rows.groupBy(*keys, "v").agg(F.sum("w").alias("k"))
                 .join(membership.select(*keys, F.col("sku").alias("v"), F.col(label).alias("c")), [*keys, "v"]))
    parts = split_in_tasks(inner(rows, named, keys), named, keys).withColumnRenamed("c", "part")
    return (parts.join(named, [*keys, "v"]).groupBy(*keys, "c").agg(F.countDistinct("part").alias("parts"))
                 .filter("parts > 1").select(*keys, "c"))


def _task(n_keys: int, tol: float, least_gain: float):
    """The function that splits one community of bounded size: from its rows (v, u, w, k of v) to (v, c)."""
    def leading(v, u, w, k):
        import numpy as np
        n = len(k)
        d = np.bincount(v, w, n) - k * k.sum()
        limit = tol * (np.abs(d) + 2 * k).max()
        product = lambda x: np.bincount(v, w * x[u], n) - d * x - k * (k @ x)
        x = np.random.default_rng(n).uniform(-1, 1, n)
        x -= x.mean()
        x /= np.sqrt(x @ x)
        mx = product(x)
        theta = x @ mx
        p = mx - theta * x
        square = p @ p
        while square > limit * limit:
            mp = product(p)
            # the Rayleigh quotient on the span of x and p
            pair = np.array([[x @ mx, mx @ p], [mx @ p, p @ mp]])
            size = np.array([[x @ x, x @ p], [x @ p, p @ p]])
            a, b, c = (pair[1, 1] * size[0, 1] - pair[0, 1] * size[1, 1], pair[1, 1] * size[0, 0] - pair[0, 0] * size[1, 1],
                       pair[0, 1] * size[0, 0] - pair[0, 0] * size[0, 1])
            q = -(b + np.copysign(np.sqrt(max(b * b - 4 * a * c, 0.0)), b)) / 2
            steps = [q / a if a else 0.0, c / q if q else 0.0]
            t = max(steps, key=lambda t: (pair[0, 0] + t * (2 * pair[0, 1] + t * pair[1, 1]))
                    / (size[0, 0] + t * (2 * size[0, 1] + t * size[1, 1])))
            x, mx = x + t * p, mx + t * mp
            norm = np.sqrt(x @ x)
            x, mx = x / norm, mx / norm
            theta = x @ mx
            r = mx - theta * x
            new = r @ r
            if t == 0:
                break
            p, square = r + (new / square) * p, new
        return theta, x

    def solve(key, rows):
        import numpy as np
        import pandas as pd
        ids = np.unique(rows["v"].to_numpy())
        v, u, w = (np.searchsorted(ids, rows["v"].to_numpy()), np.searchsorted(ids, rows["u"].to_numpy()), rows["w"].to_numpy())
        k = np.zeros(len(ids))
        k[v] = rows["k"].to_numpy()
        label = np.zeros(len(ids), np.int64)
        todo = [(np.arange(len(ids)), v, u, w)]
        while todo:
            own, v, u, w = todo.pop()
            label[own] = own[0]
            if len(own) == 1:
                continue
            theta, x = leading(v, u, w, k[own])
            plus = x > 0
            cross = plus[v] & ~plus[u]
            if theta <= 0 or 2 * (k[own][plus].sum() * k[own][~plus].sum() - w[cross].sum()) <= least_gain:
                continue
            for side in (plus, ~plus):
                number = np.cumsum(side) - 1
                kept = side[v] & side[u]
                todo.append((own[side], number[v[kept]], number[u[kept]], w[kept]))
        out = {f"k{i}": [key[i]] * len(ids) for i in range(n_keys)}
        return pd.DataFrame({**out, "v": ids, "c": ids[label]})

    return solve


def split_in_tasks(within: DataFrame, label: DataFrame, keys: list[str]) -> DataFrame:
    """``keys + [v, c]``: communities (label: keys + [v, c, k]) split to the end, one task each."""
    rows = within.join(label, [*keys, "v"])
    alone = label.select(*keys, "v", F.col("v").alias("u"), F.lit(0.0).alias("w"), "c", "k")   # for those without a link
    schema = ", ".join([f"k{i} {dict(label.dtypes)[k]}" for i, k in enumerate(keys)] + ["v bigint", "c bigint"])
    both = rows.select(*alone.columns).unionByName(alone)
    found = both.groupBy(*keys, "c").applyInPandas(_task(len(keys), TASK_TOL, GAIN), schema)
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "v", "c")


def leading_eigenvector_labels(edges: DataFrame, keys: list[str] = [KEY], task_rows: int = TASK_ROWS) -> DataFrame:
    """``keys + [sku, label]``; vertices without an edge of positive weight stay alone."""
    ck = [*keys, "c"]
    every = vertices(simplify(edges, keys), keys)
    rows = shares(edges, keys)
    strength = rows.groupBy(*keys, "v").agg(F.sum("w").alias("k"))
    comp = connected_components(rows.select(*keys, F.col("v").alias("src"), F.col("u").alias("dst")), keys)
    todo = cut_lineage(strength.join(comp.select(*keys, F.col("sku").alias("v"), F.col("comp").alias("c")), [*keys, "v"]), "labels")
    done = cut_lineage(todo.limit(0).select(*keys, "v", "c"), "labels")
    for _ in range(SAFETY):
        if todo.isEmpty():
            break
        within = cut_lineage(inner(rows, todo, keys).join(todo.select(*keys, "v", "c"), [*keys, "v"]), "inner")
        size = cut_lineage(todo.groupBy(*ck).agg(F.count(F.lit(1)).alias("n")).join(
            within.groupBy(*ck).agg(F.count(F.lit(1)).alias("links")), ck, "left"), "sizes")
        small = size.filter((F.coalesce("links", F.lit(0)) + F.col("n") <= F.lit(task_rows)) | (F.col("n") == 1)).select(*ck)
        ended = split_in_tasks(within.join(small, ck, "left_semi").drop("c"), todo.join(small, ck, "left_semi"), keys)
        done = _replaced(done, done.unionByName(ended), "labels")
        large = cut_lineage(todo.join(small, ck, "left_anti"), "labels")
        new = large
        if not large.isEmpty():
            linked_rows = within.join(large.select(*keys, "v"), [*keys, "v"], "left_semi").drop("c")
            found = leading_vectors(linked_rows, large, keys)
            good = cut_lineage(split_gains(linked_rows, found, keys).filter(
                (F.col("theta") > 0) & (F.col("gain") > F.lit(GAIN))), "splits")
            done = _replaced(done, done.unionByName(found.join(good, ck, "left_anti").select(*keys, "v", "c")), "labels")
            part = found.join(good.select(*ck), ck).withColumn("plus", F.col("x") > 0)
            first = part.groupBy(*ck, "plus").agg(F.min("v").alias("to"))
            new = cut_lineage(part.join(first, [*ck, "plus"]).select(*keys, "v", F.col("to").alias("c"), "k"), "labels")
            for table in (large, found, good):
                drop_table(table)
        for table in (todo, within, size):
            drop_table(table)
        todo = new
    else:
        raise RuntimeError("splitting did not end")
    return every.join(done, [*keys, "v"], "left").select(*keys, F.col("v").alias("sku"), F.coalesce("c", "v").alias("label"))


def _replaced(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    new = cut_lineage(new, label)
    drop_table(old)
    return new


def leading_eigenvector(edges: DataFrame, keys: list[str] = [KEY], task_rows: int = TASK_ROWS) -> DataFrame:
    """G4 (method 3): ``keys + [sku, cluster]``."""
    return as_membership(leading_eigenvector_labels(edges, keys, task_rows), keys)
