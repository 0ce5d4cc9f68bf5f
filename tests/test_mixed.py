import numpy as np
import pytest

from loomspan.operators import kernels
from loomspan.operators import mixed as X


def dense(rows, interaction, nested):
    """REML with whole matrices: estimates, standard errors and degrees of freedom of the contrasts of each phase."""
    groups, phases = sorted({r[3] for r in rows}), sorted({r[4] for r in rows})
    cells = sorted({(r[3], r[4]) for r in rows})
    own = lambda a, b: np.eye(len(cells))[cells.index((a, b))] if interaction else np.array([1.0, *(a == x for x in groups[1:]), *(b == x for x in phases[1:])])
    x, y = np.stack([own(r[3], r[4]) for r in rows]), np.array([r[5] for r in rows])
    dummy = lambda keys: (np.array(keys)[:, None] == np.array(sorted(set(keys)))).astype(float)
    z = [dummy([r[1] for r in rows])] + ([dummy([f"{r[1]}/{r[2]}" for r in rows])] if nested else [])
    n, k = x.shape

    def parts(v):
        cov = v[0] * np.eye(n) + sum(s * m @ m.T for s, m in zip(v[1:], z))
        inv = np.linalg.inv(cov)
        return cov, inv, np.linalg.inv(x.T @ inv @ x)

    def deviance(v):
        cov, inv, c = parts(v)
        r = y - x @ (c @ x.T @ inv @ y)
        return np.linalg.slogdet(cov)[1] - np.linalg.slogdet(c)[1] + r @ inv @ r

    log = np.zeros(1 + len(z))
    for _ in range(100):  # Newton in the logarithms of the variances
        f = lambda u: deviance(np.exp(u))
        g, m = X.slopes(f, log, 0.01)
        step = -np.linalg.solve(m if (np.linalg.eigvalsh(m) > 0).all() else np.eye(len(m)), g)
        log = log + step * min(1, 1 / np.abs(step).max())
        if np.abs(step).max() < 1e-10:
            break
    v = np.exp(log)
    _, inv, c = parts(v)
    beta = c @ x.T @ inv @ y
    curve = X.slopes(deviance, v / 1, float(0.02 * v.min()))[1]  # in the variances themselves
    out = {}
    for p in phases:
        for i, a in enumerate(groups):
            for b in groups[i + 1 :]:
                if interaction and not {(a, p), (b, p)} <= set(cells):
                    continue
                d = own(a, p) - own(b, p)
                h = 1e-4 * v
                g = np.array([(d @ parts(v + h * e)[2] @ d - d @ parts(v - h * e)[2] @ d) / (2 * (h @ e)) for e in np.eye(len(v))])
                s2 = d @ c @ d
                out[p, a, b] = d @ beta, np.sqrt(s2), 2 * s2**2 / (g @ np.linalg.solve(curve, g) * 2)
    return out


def unbalanced(seed=3):
    """Rows of subject, day within it, group, phase and value; sizes differ, and days of two subjects share names."""
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(11):
        group, effect = "ABC"[m % 3], rng.normal(0, 1.2)
        for day in range(2 + m % 4):
            own = rng.normal(0, 0.8)
            for k in range(1 + (m * 5 + day * 3) % 4):
                phase = "pq"[(day + k) % 2]
                rows.append(("roi", f"m{m}", day, group, phase, float(effect + own + 0.7 * (group == "B") + 0.4 * (phase == "q") + rng.normal(0, 1))))
    return rows


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "roi string, mouse string, day int, g string, p string, y double")
    return {(r.phase, r.group_a, r.group_b): r for r in X.mixed_contrasts(df.repartition(3), ["roi"], "y", "g", "p", "mouse", **how).collect()}


@pytest.mark.parametrize("interaction", [True, False])
@pytest.mark.parametrize("nested", [True, False])
def test_equals_dense_reml(spark, interaction, nested):
    rows = unbalanced()
    want, found = dense(rows, interaction, nested), got(spark, rows, interaction=interaction, nested="day" if nested else None)
    assert want.keys() == found.keys() and len(want) == 6
    for key, (estimate, se, dof) in want.items():
        r = found[key]
        assert abs(r.estimate - estimate) < 1e-6 and abs(r.se - se) < 1e-6
        assert abs(r.dof / dof - 1) < 1e-3
        assert abs(r.p_value - kernels.student_two_sided(r.estimate / r.se, r.dof)) < 1e-12
        assert abs(kernels.student_two_sided((r.high - r.estimate) / r.se, r.dof) - 0.05) < 1e-9 and np.isclose(r.estimate - r.low, r.high - r.estimate)


def test_balanced_design_has_the_classical_degrees_of_freedom(spark):
    """Four subjects a group, the same number of rows each: contrasts of groups are those of subject means, with 2 * (4 - 1) degrees."""
    rng = np.random.default_rng(8)
    rows = [("r", f"{g}{m}", k, g, "p", float(e + rng.normal())) for g in "AB" for m in range(4) for e in [rng.normal(0, 3)] for k in range(6)]
    r = got(spark, rows)["p", "A", "B"]
    means = [[np.mean([x[5] for x in rows if x[1] == f"{g}{m}"]) for m in range(4)] for g in "AB"]
    assert abs(r.estimate - (np.mean(means[0]) - np.mean(means[1]))) < 1e-9
    assert abs(r.se - np.sqrt(sum(np.var(m, ddof=1) / 4 for m in means))) < 1e-6 and abs(r.dof - 6) < 1e-3


def test_a_large_common_offset_changes_nothing(spark):
    rows = unbalanced(4)
    a, b = got(spark, rows, nested="day"), got(spark, [(*r[:5], r[5] + 1e7) for r in rows], nested="day")
    assert all(abs(a[k].estimate - b[k].estimate) < 1e-6 and abs(a[k].se - b[k].se) < 1e-6 for k in a)


def test_normal_inference_nulls_and_small_groups(spark):
    rows = unbalanced(5)
    r = got(spark, rows + [("roi", None, 1, "A", "p", 5.0), ("roi", "m1", None, "A", "p", 5.0), ("roi", "m1", 1, None, "p", 5.0), ("roi", "m1", 1, "A", "p", None), ("one", "m1", 1, "A", "p", 2.0)], nested="day", exact=False)
    assert all(x.dof == float("inf") and abs(x.high - x.estimate - 1.9599640 * x.se) < 1e-6 for x in r.values()) and len(r) == 6
    assert got(spark, []) == {}
    # without interaction a cell that was never seen still has its contrast; with it there is none
    rows = [x for x in rows if (x[3], x[4]) != ("C", "q")]
    assert len(got(spark, rows, interaction=False)) == 6 and len(got(spark, rows)) == 4


@pytest.mark.parametrize(("nested", "interaction"), [("day", True), (None, False)])
def test_blocks_of_large_groups_give_the_fit_of_one_task(spark, nested, interaction):
    """A group of 30 cells or more is fitted from blocks of subjects, the smaller ones, one of them without a name, in tasks."""
    rows = unbalanced() + [("big", *r[1:]) for r in unbalanced(6) * 2] + [(None, *r[1:]) for r in unbalanced(7)[:25]]
    df = spark.createDataFrame(rows, "roi string, mouse string, day int, g string, p string, y double")
    fit = lambda **how: {(r.roi, r.phase, r.group_a, r.group_b): r[4:] for r in X.mixed_contrasts(df, ["roi"], "y", "g", "p", "mouse", nested=nested, interaction=interaction, **how).collect()}
    whole, blocks = fit(), fit(task=26, block=8)
    assert whole.keys() == blocks.keys() and len({k[0] for k in whole}) == 3
    assert all(np.allclose(whole[k], blocks[k], rtol=1e-4, atol=1e-7) for k in whole)


@pytest.mark.parametrize("outer", [0.0, 0.7])
def test_memory_of_the_sums_grows_with_the_units_alone(outer):
    """60,000 subjects of two units: a matrix of subjects by units would be 58 GB."""
    k = 60_000
    unit = np.arange(2 * k)
    block = X.Block(2, unit % 2, unit, unit // 2, np.full(2 * k, 3.0), np.tile([1.0, -1.0], k), 5.0 * k)
    a, q = block.sums([(outer, 0.5)])[0, :4].reshape(2, 2), block.sums([(outer, 0.5)])[0, -2]
    # one subject by whole matrices
    z = np.kron(np.eye(2), np.ones((3, 1)))
    inv = np.linalg.inv(np.eye(6) + 0.5 * z @ z.T + outer * np.ones((6, 6)))
    assert np.allclose(a, k * z.T @ inv @ z) and np.isclose(q, k * (5 - 2 / 3 + (z @ [1 / 3, -1 / 3]) @ inv @ (z @ [1 / 3, -1 / 3])))


def test_limits_of_student():
    assert abs(kernels.student_limit(0.05, 10) - 2.228138852) < 1e-8 and abs(kernels.student_limit(0.05, float("inf")) - 1.959963985) < 1e-8
    assert abs(kernels.student_limit(0.01, 1) - 63.65674116) < 1e-6
