"""Eigenvectors of small symmetric matrices, and what is fitted with them, as Column expressions: no Python workers.

Cyclic Jacobi rotations: each is one projection over the matrix's entries, written once, so thousands of fits are one
grouped sum and a row-wise tail. Sums are centred beforehand, or of values of moderate size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxis.functions import vectors as V

#: Sweeps over all pairs of axes; each squares what is left off the diagonal.
SWEEPS = 5
#: The pairs of axes of a sweep; those of one round share no axis and turn together.
_ROUNDS = {3: [[(0, 1)], [(0, 2)], [(1, 2)]], 4: [[(0, 1), (2, 3)], [(0, 2), (1, 3)], [(0, 3), (1, 2)]]}


def _entry(name: str, i: int, j: int) -> str:
    return f"{name}_{min(i, j)}{max(i, j)}"


def _first(values: Column, large: Column) -> Column:
    """The first of the values whose size is the largest, but for rounding."""
    return F.get(F.filter(values, lambda x: F.abs(x) >= large * (1 - 1e-9)), F.lit(0))


def symmetric(frame: DataFrame, entries: dict[tuple[int, int], Column], n: int, name: str = "_eig") -> DataFrame:
    """Adds name_w0..name_w{n-1}, eigenvalues from the smallest, and name_v{i}{k}: component i of the k-th unit eigenvector.

    ``entries`` has the upper triangle. The sign of a vector makes its component of largest size positive (ties: the
    first); a matrix with a null entry gives nulls.
    """
    frame = frame.withColumns({_entry(name, i, j): x.cast("double") for (i, j), x in entries.items()} | {f"{name}_q{i}{j}": F.lit(float(i == j)) for i in range(n) for j in range(n)})
    kept = [f"`{c}`" for c in frame.columns if not c.startswith(f"{name}_")]
    state = [_entry(name, i, j) for i in range(n) for j in range(i, n)] + [f"{name}_q{i}{j}" for i in range(n) for j in range(n)]
    for _ in range(SWEEPS):
        for turned in _ROUNDS[n]:
            tangents, sines = [], []
            for p, q in turned:
                off, theta = _entry(name, p, q), f"(({_entry(name, q, q)} - {_entry(name, p, p)}) / (2 * {_entry(name, p, q)}))"
                # an entry too small to matter turns nothing
                tangents.append(f"case when abs({off}) <= 1e-300 then 0.0D else case when {theta} >= 0 then 1.0D else -1.0D end / (abs({theta}) + sqrt({theta} * {theta} + 1)) end as {name}_t{p}")
                sines += [f"1 / sqrt({name}_t{p} * {name}_t{p} + 1) as {name}_c{p}", f"{name}_t{p} / sqrt({name}_t{p} * {name}_t{p} + 1) as {name}_s{p}"]
            frame = frame.selectExpr("*", *tangents).selectExpr("*", *sines)
            axes = {i: [(i, "1")] for i in range(n)}
            for p, q in turned:
                axes |= {p: [(p, f"{name}_c{p}"), (q, f"-{name}_s{p}")], q: [(p, f"{name}_s{p}"), (q, f"{name}_c{p}")]}
            new = {_entry(name, i, j): " + ".join(f"{x} * {y} * {_entry(name, k, m)}" for k, x in axes[i] for m, y in axes[j]) for i in range(n) for j in range(i, n)}
            new |= {f"{name}_q{i}{j}": " + ".join(f"{x} * {name}_q{i}{k}" for k, x in axes[j]) for i in range(n) for j in range(n)}
            for p, q in turned:
                t, off = f"{name}_t{p}", _entry(name, p, q)
                new |= {_entry(name, p, p): f"{_entry(name, p, p)} - {t} * {off}", _entry(name, q, q): f"{_entry(name, q, q)} + {t} * {off}", off: f"{off} * 0.0D"}
            frame = frame.selectExpr(*kept, *(f"{new[c]} as {c}" for c in state))
    pairs = F.array_sort(F.array(*(F.struct(F.col(_entry(name, k, k)).alias("w"), F.array(*(F.col(f"{name}_q{i}{k}") for i in range(n))).alias("v")) for k in range(n))))
    frame = frame.withColumn(f"{name}_pairs", pairs)
    used = [c for c in frame.columns if c.startswith(f"{name}_") and c != f"{name}_pairs"]
    frame = frame.drop(*used)
    out = {f"{name}_w{k}": F.get(f"{name}_pairs", F.lit(k))["w"] for k in range(n)}
    for k in range(n):
        v = F.get(f"{name}_pairs", F.lit(k))["v"]
        large = F.array_max(F.transform(v, lambda x: F.abs(x)))
        out |= {f"{name}_v{i}{k}": F.get(v, F.lit(i)) * F.signum(_first(v, large)) for i in range(n)}
    return frame.withColumns(out).drop(f"{name}_pairs")


def plane_fit(points: DataFrame, *by: str) -> DataFrame:
    """(by..., n, normal nx ny nz, centroid cx cy cz, rms): the plane nearest to the points x, y, z of each group.

    Points with a null coordinate do not count. Fewer than three points, or all on one line (the middle eigenvalue is no
    more than 1e-12 of the largest), have no plane: normal and rms are null.
    """
    usable = points.filter("x is not null and y is not null and z is not null")
    n = F.count(F.lit(1))
    sums = usable.groupBy(*by).agg(
        n.alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"), *(F.covar_pop(a, b).alias(f"_{a}{b}") for k, a in enumerate("xyz") for b in "xyz"[k:]),
    )
    at = {(i, j): F.col(f"_{a}{b}") for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j}
    solved = symmetric(sums, at, 3)
    flat = (F.col("n") >= 3) & (F.col("_eig_w1") > 1e-12 * F.col("_eig_w2"))
    normal = [F.when(flat, F.col(f"_eig_v{i}0")).alias(f"n{c}") for i, c in enumerate("xyz")]
    return solved.select(*by, "n", *normal, "cx", "cy", "cz", F.when(flat, F.sqrt(F.greatest(F.col("_eig_w0"), F.lit(0.0)))).alias("rms"))


def similarity_fit(pairs: DataFrame, *by: str) -> DataFrame:
    """(by..., n, scale, r0..r8, t0..t2, rms): the similarity that takes points x, y, z nearest to u, v, w, by group.

    The rotation is the unit quaternion of the largest eigenvalue of a symmetric 4 x 4 matrix made from the cross
    covariance, so it is proper even where a reflection would fit better. Rows with a null do not count. A group whose
    points lie on one line, or number fewer than three, has no single rotation: all but n is null.
    """
    names, targets = "xyz", "uvw"
    usable = pairs.filter(" and ".join(f"{c} is not null" for c in names + targets))
    sums = usable.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"_m{c}") for c in names + targets),
        *(F.covar_pop(a, b).alias(f"_s{a}{b}") for a in names for b in targets), *(F.var_pop(c).alias(f"_o{c}") for c in names + targets),
        *(F.covar_pop(a, b).alias(f"_k{a}{b}") for k, a in enumerate(names) for b in names[k + 1 :]),
    )
    s = lambda a, b: F.col(f"_s{a}{b}")
    quaternion = {
        (0, 0): s("x", "u") + s("y", "v") + s("z", "w"), (0, 1): s("y", "w") - s("z", "v"), (0, 2): s("z", "u") - s("x", "w"), (0, 3): s("x", "v") - s("y", "u"),
        (1, 1): s("x", "u") - s("y", "v") - s("z", "w"), (1, 2): s("x", "v") + s("y", "u"), (1, 3): s("z", "u") + s("x", "w"),
        (2, 2): s("y", "v") - s("x", "u") - s("z", "w"), (2, 3): s("y", "w") + s("z", "v"), (3, 3): s("z", "w") - s("x", "u") - s("y", "v"),
    }
    spread = {(i, j): F.col(f"_o{a}") if i == j else F.col(f"_k{a}{b}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}
    solved = symmetric(symmetric(sums, quaternion, 4, "_rot"), spread, 3, "_own")
    a, b, c, d = (F.col(f"_rot_v{i}3") for i in range(4))
    r = [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c), 2 * (b * c + a * d), a * a - b * b + c * c - d * d, 2 * (c * d - a * b), 2 * (b * d - a * c), 2 * (c * d + a * b), a * a - b * b - c * c + d * d]
    solved = solved.withColumns({f"_r{k}": x for k, x in enumerate(r)})
    r = [F.col(f"_r{k}") for k in range(9)]
    spread_of = lambda cs: F.col(f"_o{cs[0]}") + F.col(f"_o{cs[1]}") + F.col(f"_o{cs[2]}")
    # the largest eigenvalue is the trace of R' times the cross covariance
    solved = solved.withColumn("_scale", F.try_divide(F.col("_rot_w3"), spread_of(names)))
    shift = [F.col(f"_m{t}") - F.col("_scale") * x for t, x in zip(targets, V.matvec(r, [F.col(f"_m{c}") for c in names]))]
    left = spread_of(targets) - F.col("_scale") * F.col("_rot_w3")
    good = (F.col("n") >= 3) & (F.col("_own_w1") > 1e-12 * F.col("_own_w2")) & (F.col("_rot_w3") - F.col("_rot_w2") > 1e-12 * F.abs(F.col("_rot_w3")))
    only = lambda x: F.when(good, x)
    return solved.select(*by, "n", only(F.col("_scale")).alias("scale"), *(only(x).alias(f"r{k}") for k, x in enumerate(r)), *(only(x).alias(f"t{k}") for k, x in enumerate(shift)), only(F.sqrt(F.greatest(left, F.lit(0.0)))).alias("rms"))
