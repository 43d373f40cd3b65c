"""Two-layer learned index: a top model routes keys to leaves, a leaf's line predicts the rank.

Every model is a handful of aggregates and a column expression: training is one aggregation, routing and
prediction stay in generated code. Leaves are trained by one grouped aggregation in which the last point of
the non-empty leaf before and the first of the one behind take part. A leaf's error covers its own keys and
the absent keys up to its neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.operators.keys import ordinal, rank_of, running
from pagelore.runtime import stored

TOP_ONLY = ("radix", "radix8", "radix18", "radix22", "radix26", "radix28", "normal", "lognormal", "loglinear", "robust_linear", "histogram", "bradix")
ANYWHERE = ("linear", "linear_spline", "cubic")


def validate(top: str, leaf: str) -> None:
    if top not in TOP_ONLY + ANYWHERE:
        raise ValueError(f"unknown top model {top}")
    if leaf not in ANYWHERE:
        raise ValueError(f"{leaf} can't be a leaf model")


def _line(slope, at_x, at_y):
    return lambda x: at_y + slope * (x - at_x)


def fit(points: DataFrame, kind: str, x: str = "key", y: str = "pos"):
    """A function of a key column, or Steps, from points (x, y); without points it predicts 0."""
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    if kind == "linear":
        r = points.agg(F.regr_slope(Y, X).alias("b"), F.avg(X).alias("mx"), F.avg(Y).alias("my")).first()
        return _line(r.b or 0.0, r.mx or 0.0, r.my or 0.0)
    if kind == "robust_linear":
        n = points.count()
        cutn = int(n * 0.0001) + 1
        some = ordinal(points.select(x, y), [x, y], "_o").where((F.col("_o") >= cutn) & (F.col("_o") < n - cutn)) if n > 2 * cutn + 1 else points
        return fit(some, "linear", x, y)
    if kind == "loglinear":
        f = fit(points.where(Y > 0).withColumn("_ly", F.log(Y)), "linear", x, "_ly")
        return lambda c: F.pow(1 + f(c) / 64, F.lit(64.0))
    if kind == "linear_spline":
        r = points.agg(F.min(X).alias("x0"), F.max(X).alias("x1"), F.min_by(Y, X).alias("y0"), F.max_by(Y, X).alias("y1")).first()
        return _line((r.y1 - r.y0) / (r.x1 - r.x0) if r.x0 is not None and r.x1 > r.x0 else 0.0, r.x0 or 0.0, r.y0 or 0.0)
    if kind in ("normal", "lognormal"):
        Z = F.coalesce(F.when(F.col(x) > 0, F.log(X)), F.lit(0.0)) if kind == "lognormal" else X
        r = points.agg(F.avg(Z).alias("m"), F.stddev_pop(Z).alias("s"), F.max(Y).alias("top")).first()
        scale = 1.65451 / r.s if r.s else 0.0

        def phi(c):
            z = F.coalesce(F.when(c > 0, F.log(c)), F.lit(0.0)) if kind == "lognormal" else c
            return (r.top or 0.0) / (1 + F.exp(-scale * (z - (r.m or 0.0))))

        return phi
    if kind == "cubic":
        return _cubic(points, x, y)
    if kind == "radix":
        r = _ends(points, x, y)
        return (lambda c: F.lit(0.0)) if r.a is None else _top_bits(int(r.a), int(r.b), max(1, int(r.top or 0).bit_length()))
    if kind == "bradix":
        return _balanced(points, x, y)
    if kind.startswith("radix"):
        return _radix_table(points, int(kind[5:]), x, y)
    if kind == "histogram":
        return _histogram(points, x, y)
    raise ValueError(f"unknown model {kind}")


def common_prefix_bits(a: int, b: int) -> int:
    """Leading bits that all keys from a to b share."""
    return 64 - (a ^ b).bit_length()


def _cubic(points, x, y):
    """Monotone cubic through the end points, its end slopes from the nearest other points; the straight
    line instead where that is nearer to the points on the whole."""
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    r = points.agg(F.min(X).alias("x0"), F.max(X).alias("x1"), F.min_by(Y, X).alias("y0"), F.max_by(Y, X).alias("y1")).first()
    line = fit(points, "linear_spline", x, y)
    if r.x0 is None or r.x1 == r.x0 or r.y1 == r.y0:
        return line
    inner = points.where((X > r.x0) & (X < r.x1)).agg(F.min(X).alias("a"), F.max(X).alias("b"), F.min_by(Y, X).alias("ya"), F.max_by(Y, X).alias("yb")).first()
    w, h = r.x1 - r.x0, r.y1 - r.y0
    m0 = (inner.ya - r.y0) / h / ((inner.a - r.x0) / w) if inner.a is not None else 1.0
    m1 = (r.y1 - inner.yb) / h / ((r.x1 - inner.b) / w) if inner.b is not None else 1.0
    if (size := math.hypot(m0, m1)) > 3:
        m0, m1 = 3 * m0 / size, 3 * m1 / size

    def cubic(c):
        t = (c - r.x0) / w
        return r.y0 + h * t * (m0 + t * ((3 - 2 * m0 - m1) + t * (m0 + m1 - 2)))

    off = points.agg(F.sum(F.abs(cubic(X) - Y)).alias("c"), F.sum(F.abs(line(X) - Y)).alias("l")).first()
    return cubic if off.c <= off.l else line


def _ends(points, x, y):
    return points.agg(F.min(F.col(x)).alias("a"), F.max(F.col(x)).alias("b"), F.max(F.col(y).cast("double")).alias("top"), F.count("*").alias("n")).first()


def _top_bits(a: int, b: int, bits: int):
    """The key's first bits behind the prefix that a and b share, as a number."""
    shared = common_prefix_bits(a, b)
    shift, base = max(0, 64 - shared - bits), a >> (64 - shared) << (64 - shared) if shared < 64 else a
    return lambda c: F.floor((c - base) / float(1 << shift))


def _balanced(points, x, y):
    """Top bits whose excess over the outputs is cut off at one end: of two widths and both ends the choice that
    deals keys most evenly, by chi square. All choices are counted in one aggregation."""
    r = _ends(points, x, y)
    top = int(r.top or 0)
    if r.a is None or top < 1:
        return lambda c: F.lit(0.0)
    choices = []
    for bits in range(top.bit_length(), min(top.bit_length() + 2, 64)):
        of, spare = _top_bits(int(r.a), int(r.b), bits), top - ((1 << (bits + 1)) - 1)
        choices.append(lambda c, of=of: F.least(of(c), F.lit(top - 1)))
        if spare >= 0:
            choices.append(lambda c, of=of, spare=spare: F.greatest(of(c) - spare, F.lit(0)))
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), f(F.col(x).cast("double")).cast("bigint").alias("bin")) for i, f in enumerate(choices)])).alias("z")
    # The sum of (count - mean)^2 / mean over all bins differs from that of count^2 by constants.
    squares = points.select(bins).select("z.*").groupBy("i", "bin").count().groupBy("i").agg(F.sum((F.col("count") * F.col("count")).cast("double")).alias("s")).collect()
    return choices[min((q.s, q.i) for q in squares)[1]]


class Steps:
    """A step function as a table: ascending (s, v). A key takes the value of the last s at or below its slot or, with
    ``above``, of the first at or above it. Looked up by an as-of join, so the table may have any size."""

    def __init__(self, steps: DataFrame, slot, above: bool, otherwise: float):
        self.steps, self.slot, self.above, self.otherwise = stored(ordinal(steps, ["s"], "_i"), "steps"), slot, above, otherwise

    def scores(self, df: DataFrame) -> DataFrame:
        """df (key, ...) + _top."""
        p = df.select(F.struct(*df.columns).alias("_df"), self.slot(F.col("key")).cast("bigint").alias("key"), F.monotonically_increasing_id().alias("query_idx"))
        r = rank_of(p, self.steps.withColumnRenamed("s", "key"), not self.above, name="_n")
        r = r.withColumn("_i", F.col("_n") - (0 if self.above else 1))
        return r.join(self.steps.select("_i", "v"), "_i", "left").select("_df.*", F.coalesce("v", F.lit(self.otherwise)).alias("_top"))


def _radix_table(points, bits, x, y):
    """The first rank under each value of the key's top bits behind the shared prefix; a value without keys
    has the next one's. Only values with keys are stored, so 28 bits are as good as 8."""
    if not 1 <= bits <= 28:
        raise ValueError("a radix table has 1 to 28 bits")
    r = _ends(points, x, y)
    if r.a is None:
        return lambda c: F.lit(0.0)
    of = _top_bits(int(r.a), int(r.b), bits)
    slot = lambda c: F.least(F.greatest(of(c.cast("double")), F.lit(0)), F.lit((1 << bits) - 1))
    return Steps(points.groupBy(slot(F.col(x)).cast("bigint").alias("s")).agg(F.min(F.col(y).cast("double")).alias("v")), slot, True, float(r.top))


def _histogram(points, x, y):
    """Equi-depth: as many bins as the greatest output; a key predicts the last bin that starts at or below it."""
    r = _ends(points, x, y)
    if r.a is None:
        return lambda c: F.lit(0.0)
    bins = max(1, int(r.top or 0))
    depth = max(1, r.n // bins)
    at = ordinal(points.select(x, y), [x, y], "_o").where((F.col("_o") % depth == 0) & (F.col("_o") < bins * depth))
    return Steps(at.groupBy(F.col(x).alias("s")).agg(F.max(F.col("_o") / depth).alias("v")), lambda c: c, False, 0.0)


class Rmi:
    """leaves: (leaf_id, a, x0, y0, err): pred = y0 + a (x - x0), cut to [0, n - 1]; cubic ones have w, m0 and m1 too."""

    def __init__(self, top, leaves: DataFrame, bf: int, n: int, cubic: bool = False):
        self.top, self.leaves, self.bf, self.n, self.cubic = top, leaves, bf, n, cubic

    def routed(self, rows: DataFrame) -> DataFrame:
        """rows (key, ...) + leaf_id."""
        steps = isinstance(self.top, Steps)
        rows = self.top.scores(rows) if steps else rows
        top = F.col("_top") if steps else self.top(F.col("key").cast("double"))
        return rows.withColumn("leaf_id", F.least(F.greatest(F.floor(top), F.lit(0)), F.lit(self.bf - 1)).cast("int")).drop("_top")

    def predict(self, probes: DataFrame) -> DataFrame:
        """probes + leaf_id, err, pred."""
        p = self.routed(probes).join(self.leaves, "leaf_id", "left")
        return p.withColumn("pred", _cut(_at(F.col("key"), self.cubic), self.n)).withColumn("err", F.coalesce("err", F.lit(0).cast("bigint"))).drop("a", "x0", "y0", "w", "m0", "m1")

    def size_bytes(self) -> int:
        return 16 + (40 if self.cubic else 24) * self.bf


def _at(key, cubic: bool = False):
    line = F.col("y0") + F.col("a") * (key.cast("double") - F.col("x0"))
    if not cubic:
        return line
    t, m0, m1 = (key.cast("double") - F.col("x0")) / F.col("w"), F.col("m0"), F.col("m1")
    return F.when(m0.isNull(), line).otherwise(F.col("y0") + F.col("a") * F.col("w") * t * (m0 + t * ((3 - 2 * m0 - m1) + t * (m0 + m1 - 2))))


def _cut(pred, n):
    return F.coalesce(F.least(F.greatest(F.floor(pred), F.lit(0)), F.lit(n - 1)).cast("bigint"), F.lit(0).cast("bigint"))


def train(ranked_keys: DataFrame, top: str = "linear", leaf: str = "linear", bf: int = 64) -> Rmi:
    """The top model is fitted on ranks scaled to [0, bf). Leaf kinds: linear, linear_spline and cubic. Empty
    leaves have no row: they predict 0 with error 0."""
    validate(top, leaf)
    k = ranked_keys.select("key", "pos")
    n = k.count()
    scaled = k.withColumn("pos", F.col("pos") * (bf / max(1, n)))
    model = Rmi(fit(scaled, top), None, bf, n, leaf == "cubic")
    routed = stored(model.routed(k), "routed")
    ends = routed.groupBy("leaf_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("keys"))
    ends = stored(ordinal(ends, ["leaf_id"], "_o"), "ends")
    before = ends.select((F.col("_o") + 1).alias("_o"), F.col("last_key").alias("prev_key"), F.col("last_pos").alias("prev_pos"))
    behind = ends.select((F.col("_o") - 1).alias("_o"), F.col("first_key").alias("next_key"), F.col("first_pos").alias("next_pos"))
    ends = ends.join(before, "_o", "left").join(behind, "_o", "left")
    border = lambda kc, pc: ends.where(F.col(kc).isNotNull()).select(F.col(kc).alias("key"), F.col(pc).alias("pos"), "leaf_id")
    points = routed.select("key", "pos", "leaf_id").unionByName(border("prev_key", "prev_pos")).unionByName(border("next_key", "next_pos"))
    X, Y = F.col("key").cast("double"), F.col("pos").cast("double")
    if leaf == "linear":
        g = points.groupBy("leaf_id").agg(F.coalesce(F.regr_slope(Y, X), F.lit(0.0)).alias("a"), F.avg(X).alias("x0"), F.avg(Y).alias("y0"))
    else:
        slope = (F.max(Y) - F.min(Y)) / F.nullif(F.max(X) - F.min(X), F.lit(0.0))
        g = points.groupBy("leaf_id").agg(F.coalesce(slope, F.lit(0.0)).alias("a"), F.min(X).alias("x0"), F.min(Y).alias("y0"), F.max(X).alias("x1"), F.max(Y).alias("y1"))
        g = _cubic_leaves(points, g) if leaf == "cubic" else g.drop("x1", "y1")
    at = lambda key: _cut(_at(key, model.cubic), n)
    own = routed.join(g, "leaf_id").groupBy("leaf_id").agg(F.max(F.abs(at(F.col("key")) - F.col("pos"))).alias("own"))
    g = g.join(own, "leaf_id").join(ends.select("leaf_id", "prev_key", "prev_pos", "next_key", "next_pos"), "leaf_id")
    gap_up = F.abs(at(F.col("next_key") - 1) - F.col("next_pos"))
    gap_down = F.abs(at(F.col("prev_key") + 1) - F.col("prev_pos"))
    model.leaves = stored(g.select("leaf_id", "a", "x0", "y0", *(["w", "m0", "m1"] if model.cubic else []), F.greatest("own", F.when(F.col("next_key").isNotNull(), gap_up), F.when(F.col("prev_key").isNotNull(), gap_down)).alias("err")), "leaves")
    return model


def _cubic_leaves(points: DataFrame, ends: DataFrame) -> DataFrame:
    """Leaves (leaf_id, a, x0, y0, x1, y1) -> a, x0, y0, w, m0, m1: end slopes in units of the leaf's box, from the
    points nearest to its ends; null where the straight line is nearer to the points on the whole."""
    X, Y = F.col("key").cast("double"), F.col("pos").cast("double")
    box = ends.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    p = points.join(box, "leaf_id")
    inner = p.where((X > F.col("x0")) & (X < F.col("x1")))
    sx, sy = (X - F.col("x0")) / F.col("w"), (Y - F.col("y0")) / F.nullif(F.col("h"), F.lit(0.0))
    slope = inner.groupBy("leaf_id").agg(F.min_by(sy / sx, X).alias("m0"), F.max_by((1 - sy) / (1 - sx), X).alias("m1"))
    m = box.join(slope, "leaf_id", "left")
    long = F.sqrt(F.col("m0") * F.col("m0") + F.col("m1") * F.col("m1"))
    m = m.withColumn("_f", F.when(long > 3, 3 / long).otherwise(F.lit(1.0))).withColumns({c: F.when((F.col("w") > 0) & (F.col("h") > 0), F.coalesce(F.col(c) * F.col("_f"), F.lit(1.0))) for c in ("m0", "m1")})
    m = stored(m.select("leaf_id", "a", "x0", "y0", "w", "m0", "m1"), "cubics")
    off = points.join(m, "leaf_id").groupBy("leaf_id").agg(F.sum(F.abs(_at(F.col("key"), True) - Y)).alias("c"), F.sum(F.abs(_at(F.col("key")) - Y)).alias("l"))
    bent = F.col("c") <= F.col("l")
    return m.join(off, "leaf_id").select("leaf_id", "a", "x0", "y0", "w", F.when(bent, F.col("m0")).alias("m0"), F.when(bent, F.col("m1")).alias("m1"))


def train_bounded(ranked_keys: DataFrame, line: int, top: str = "linear", bf: int = 64) -> tuple[Rmi, DataFrame]:
    """A model over the knots of a line-aligned spline, and the knots (key, rank, pos): a lookup goes to the
    knot before it and interpolates to the next. The spline is one sequential pass, in chunks of keys."""
    import pyarrow as pa

    from pagelore.operators.keys import ranked

    def run(batches):
        at, ks, rs = None, [], []
        for b in batches:
            for c, k, p in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if c != at and ks:
                    yield knots(ks, rs)
                    ks, rs = [], []
                at = c
                ks.append(k)
                rs.append(p)
        if ks:
            yield knots(ks, rs)

    def knots(ks, rs):
        out = line_spline(ks, rs, line)
        return pa.record_batch([pa.array([k for k, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], names=["key", "rank"])

    rows = ranked_keys.select(F.floor(F.col("pos") / (1 << 18)).cast("bigint").alias("chunk"), "key", "pos")
    found = stored(rows.repartition("chunk").sortWithinPartitions("chunk", "pos").mapInArrow(run, "key bigint, rank bigint"), "knots")
    at = ranked(found.select("key")).join(found, "key").select("key", "rank", "pos")
    return train(at, top, "linear", bf), at


def error_stats(model: Rmi, ranked_keys: DataFrame) -> DataFrame:
    """avg_error, avg_l2, avg_log2 and max over keys of their leaf's error. Squares are summed as doubles: those of a
    poor model of some 3 million keys pass 2^63."""
    k = model.predict(ranked_keys.select("key", "pos"))
    return k.agg(F.avg("err").alias("avg_error"), F.avg(F.pow(F.col("err").cast("double"), F.lit(2.0))).alias("avg_l2"), F.avg(F.log2(2.0 * F.col("err") + 2)).alias("avg_log2"), F.max("err").alias("max_error"))


def collect_records(model: Rmi, probes: DataFrame, ranked_keys: DataFrame, max_err: float = 0.25, max_share: float = 0.99) -> DataFrame:
    """(query_idx, true_pos, leaf_id, err, pred_pos, key) of each probe; degenerate models are refused."""
    from pagelore.operators.keys import predecessor

    r = model.predict(predecessor(probes, ranked_keys)).select("query_idx", F.col("pos").alias("true_pos"), "leaf_id", "err", F.col("pred").alias("pred_pos"), "key")
    worst = r.agg(F.max("err").alias("e"), F.count("*").alias("n")).first()
    top = r.groupBy("leaf_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if worst.n and (worst.e > max_err * model.n or top > max_share * worst.n):
        raise ValueError(f"degenerate model: error {worst.e} of {model.n}, {top} of {worst.n} probes in one leaf")
    return r


def pareto_front(configs: DataFrame, size: str = "size", err: str = "avg_log2") -> DataFrame:
    """configs that no other beats in one of size and error without losing in the other: those with the least
    error of their size, if it is less than that of every smaller size. One running minimum over sizes."""
    least = running(configs.groupBy(F.col(size).alias("_s")).agg(F.min(F.col(err).cast("double")).alias("_e")), ["_s"], {"_upto": "_e"}, "min")
    # The least error up to a size is first reached at the size that is on the front.
    first = least.groupBy("_upto").agg(F.min("_s").alias("_s")).select("_s", F.col("_upto").alias("_e"))
    return configs.join(first, (F.col(size) == F.col("_s")) & (F.col(err) == F.col("_e"))).select(*configs.columns)


def narrow(front: list[dict], keep: int, size: str = "size", err: str = "avg_log2") -> list[dict]:
    """Of the pair nearest in size the less accurate goes, until keep are left."""
    rows = sorted(front, key=lambda r: r[size])
    while len(rows) > max(1, keep):
        k = min(range(len(rows) - 1), key=lambda i: rows[i + 1][size] / max(1, rows[i][size]))
        rows.pop(k if rows[k][err] > rows[k + 1][err] else k + 1)
    return sorted(rows, key=lambda r: r[err])


def search_space(profile: str = "default", step: int = 1) -> list[tuple[str, str, int]]:
    tops = ["radix", "radix18", "radix22", "robust_linear", *(["normal", "lognormal", "loglinear"] if profile == "disk" else []), *ANYWHERE]
    last = 27 if profile == "disk" else 24
    return [(t, leaf, 1 << b) for t in tops for leaf in ANYWHERE for b in range(6, last + 1, step)]


def measure(ranked_keys: DataFrame, configs: list[tuple[str, str, int]]) -> list[dict]:
    out = []
    for top, leaf, bf in configs:
        m = train(ranked_keys, top, leaf, bf)
        s = error_stats(m, ranked_keys).first()
        out.append({"layers": f"{top},{leaf}", "branching_factor": bf, "size": m.size_bytes(), "avg_log2": s.avg_log2, "max_error": s.max_error})
    return out


def optimize(ranked_keys: DataFrame, keep: int = 10, configs=None, finer=None) -> list[dict]:
    """Two phases: a coarse grid; then, for the model pairs on its front, all branching factors not seen
    yet, of whose front at most ``keep`` stay, by error."""
    spark = ranked_keys.sparkSession
    first = measure(ranked_keys, configs or search_space(step=5))
    front = [r.asDict() for r in pareto_front(spark.createDataFrame(first)).collect()]
    pairs, seen = {r["layers"] for r in front}, {(r["layers"], r["branching_factor"]) for r in first}
    second = [(t, leaf, b) for t, leaf, b in (finer or search_space()) if f"{t},{leaf}" in pairs and (f"{t},{leaf}", b) not in seen]
    rows = measure(ranked_keys, second) or first
    return narrow([r.asDict() for r in pareto_front(spark.createDataFrame(rows)).collect()], keep)


def smallest_error_below(front: list[dict], max_size: int) -> dict | None:
    return next((r for r in sorted(front, key=lambda r: r["avg_log2"]) if r["size"] < max_size), None)


def line_spline(keys, ranks, line: int):
    """Knots of a greedy spline that predicts every key inside its line of ``line`` ranks: a corridor of the
    line's bounds around the last knot, moved on when a key leaves it."""
    keys, ranks = list(keys), list(ranks)
    knots = [(keys[0], ranks[0])] if keys else []
    low, high, prev = None, None, knots[0] if knots else None
    for k, r in zip(keys[1:], ranks[1:], strict=True):
        x0, y0 = knots[-1]
        a, b = r // line * line, r // line * line + line - 1
        lo, hi = (a - y0) / (k - x0), (b - y0) / (k - x0)
        mid = (r - y0) / (k - x0)
        if low is not None and not low <= mid <= high:
            knots.append(prev)
            x0, y0 = prev
            low, high = ((a - y0) / (k - x0), (b - y0) / (k - x0))
        else:
            low, high = (lo if low is None else max(low, lo)), (hi if high is None else min(high, hi))
        prev = (k, r)
    if prev is not None and prev != knots[-1]:
        knots.append(prev)
    return knots
