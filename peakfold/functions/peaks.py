"""Column functions over peak lists: array<struct<mz double, intensity double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK = "struct<mz:double,intensity:double>"
TOLERANCE = 0.02  # Da
PPM = 5.0


def above_noise(peaks: Column, threshold: float) -> Column:
    """Peaks of at least this intensity; at 0 or below none is taken away, not even NaN."""
    if not threshold > 0:
        return peaks
    return F.filter(peaks, lambda p: (p["intensity"] >= F.lit(float(threshold))) & ~F.isnan(p["intensity"]))


def strongest(peaks: Column, n: int) -> Column:
    """The n most intense peaks, most intense first, then by m/z."""
    keyed = F.array_sort(F.transform(peaks, lambda p: F.struct((-p["intensity"]).alias("by"), p["mz"].alias("mz"), p["intensity"].alias("intensity"))))
    return F.transform(F.slice(keyed, 1, n), lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity")))


def base_peak(peaks: Column) -> Column:
    """The most intense peak, the first of equals in the list's order."""
    keyed = F.array_max(F.transform(peaks, lambda p, i: F.struct(p["intensity"].alias("intensity"), (-i).alias("by"), p["mz"].alias("mz"))))
    return F.when(F.size(peaks) > 0, F.struct(keyed["mz"].alias("mz"), keyed["intensity"].alias("intensity")))


def ppm_error(theoretical: Column, experimental: Column) -> Column:
    return F.abs(theoretical - experimental) / theoretical * F.lit(1e6)


def ppm_ok(theoretical: Column, experimental: Column, limit: float = PPM) -> Column:
    return ppm_error(theoretical, experimental) <= F.lit(float(limit))


def list_error(peaks: Column, label: str) -> Column:
    """Null, or what is wrong with a peak list: none, or the first negative intensity."""
    bad = F.array_min(F.filter(F.transform(peaks, lambda p, i: F.when(p["intensity"] < 0, F.struct(i.alias("i"), p["intensity"].alias("x")))), lambda b: b.isNotNull()))
    text = F.concat(F.lit(f"{label} peak ["), bad["i"].cast("string"), F.lit("] has negative intensity ("), bad["x"].cast("string"), F.lit(")"))
    return F.when(F.coalesce(F.size(peaks), F.lit(0)) < 1, F.lit(f"{label} peaks must not be empty")).when(bad.isNotNull(), text)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used in there."""
    return F.transform(F.array(value), body)[0]


def lower_bound(items: Column, steps: Column, below) -> Column:
    """The number of leading items for which ``below`` holds, which no later one follows for which it does:
    a binary search by ``steps``, falling powers of two that sum to the length at least."""
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(items)) & below(F.get(items, at + s - 1)), at + s).otherwise(at))


def halving(n: Column) -> Column:
    """Falling powers of two whose sum is n at least."""
    return F.transform(F.sequence(F.length(F.bin(n)) - 1, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))


def greedy_match(query: Column, reference: Column, tolerance: Column | float = TOLERANCE) -> Column:
    """struct<score, n, unmatched> of the greedy one-to-one matching.

    The query's peaks are taken in their order.  Each takes the nearest peak of the reference within
    the tolerance (both ends of mz - tol .. mz + tol belong to it) that none has taken; of two equally
    near the lower m/z.  score is the cosine of the matched intensities, 0 without any.

    The reference is sorted once.  A query peak finds the two ends of its window by binary search and
    looks at that slice alone; taken peaks below the window are forgotten if the query rises in m/z.
    """
    tol = F.lit(float(tolerance)) if isinstance(tolerance, (int, float)) else tolerance
    valid = lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull()
    ordered = F.transform(F.array_sort(F.filter(reference, valid)), lambda p, i: F.struct(p["mz"].alias("mz"), p["intensity"].alias("x"), i.alias("i")))
    own = F.filter(query, valid)
    rises = F.array_sort(F.transform(own, lambda p: p["mz"])) == F.transform(own, lambda p: p["mz"])
    sides = F.struct(ordered.alias("ref"), own.alias("query"), rises.alias("rises"), halving(F.greatest(F.size(ordered), F.lit(1))).alias("steps"))
    start = F.struct(
        F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{PEAK}>").alias("unmatched"),
        F.lit(0.0).alias("dot"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("n"),
    )

    def matched(both: Column) -> Column:
        ref, steps = both["ref"], both["steps"]

        def step(acc: Column, p: Column) -> Column:
            low = lower_bound(ref, steps, lambda r: r["mz"] < p["mz"] - tol)
            high = lower_bound(ref, steps, lambda r: r["mz"] <= p["mz"] + tol)
            return let(F.struct(low.alias("low"), high.alias("high")), lambda w: taken(acc, p, w))

        def taken(acc: Column, p: Column, w: Column) -> Column:
            near = F.filter(F.slice(ref, w["low"] + 1, w["high"] - w["low"]), lambda r: ~F.array_contains(acc["used"], r["i"]))
            best = F.array_min(F.transform(near, lambda r: F.struct(F.abs(r["mz"] - p["mz"]).alias("d"), r["i"].alias("i"), r["x"].alias("x"))))
            lost = F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity"))
            used = F.when(both["rises"], F.filter(acc["used"], lambda i: i >= w["low"])).otherwise(acc["used"])

            def take(b: Column) -> Column:
                return F.when(
                    b.isNull(),
                    F.struct(used.alias("used"), F.array_append(acc["unmatched"], lost).alias("unmatched"), acc["dot"].alias("dot"), acc["a"].alias("a"), acc["b"].alias("b"), acc["n"].alias("n")),
                ).otherwise(
                    F.struct(
                        F.array_append(used, b["i"]).alias("used"), acc["unmatched"].alias("unmatched"), (acc["dot"] + p["intensity"] * b["x"]).alias("dot"),
                        (acc["a"] + p["intensity"] * p["intensity"]).alias("a"), (acc["b"] + b["x"] * b["x"]).alias("b"), (acc["n"] + 1).alias("n"),
                    )
                )

            return let(best, take)

        return F.aggregate(both["query"], start, step, finish)

    def finish(acc: Column) -> Column:
        zero = (acc["a"] == 0) | (acc["b"] == 0)
        return F.struct(F.when(zero, 0.0).otherwise(acc["dot"] / (F.sqrt(acc["a"]) * F.sqrt(acc["b"]))).alias("score"), acc["n"].alias("n"), acc["unmatched"].alias("unmatched"))

    return let(sides, matched)


def vector_cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors or zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) < 1) | (F.size(b) < 1) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def mz_bin(mz: Column) -> Column:
    """Of 1,024 bins of 2 Da; values beyond either end go to the last bin there."""
    return F.least(F.greatest((mz / F.lit(2.0)).cast("bigint"), F.lit(0).cast("bigint")), F.lit(1023).cast("bigint"))


def fmt_intensity(x: Column) -> Column:
    """Two decimals, or two and a power of ten from a million on.  Half is rounded up by the shortest
    decimal that stands for the double, as Java does; C and Python look at the double itself."""
    return F.when(F.abs(x) >= 1e6, F.format_string("%.2e", x)).otherwise(F.format_string("%.2f", x))


def ion_mask(peaks: Column, ions: list[tuple[int, str, float]], tolerance: float = TOLERANCE) -> Column:
    """A bit for each ion of positive m/z that some peak lies within the tolerance of."""
    mask = F.lit(0)
    for bit, _, mass in ions:
        if mass > 0:
            mask = mask + F.when(F.exists(peaks, _within(mass, tolerance)), 1 << bit).otherwise(0)
    return mask


def _within(mass: float, tolerance: float):
    return lambda p: F.abs(p["mz"] - F.lit(mass)) <= F.lit(tolerance)


def fmt_mz(x: Column) -> Column:
    return F.format_string("%.4f", x)


def fmt_rt(x: Column) -> Column:
    """Minutes, or N/A where there are none."""
    return F.when(x.isNull(), "N/A").otherwise(F.format_string("%.2f", x))


def to_double(x: Column) -> Column:
    return x.try_cast("double")


def maybe_int(x: Column) -> Column:
    """A whole number as text, or a question mark."""
    return F.coalesce(x.try_cast("int").cast("string"), F.lit("?"))
