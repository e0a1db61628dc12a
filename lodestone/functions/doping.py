"""Doping shares: the elements of a target dealt over the sublattices of its parent, a transport problem for each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.chemistry import MEASURED
from lodestone.functions.composition import pairs
from lodestone.registry import query

# Elements that sit on anion sites; spacer cations, whose sites may be emptier; both vacancies and the overfill
# of anion sites; how unlike an element may be that sits on another's sites, and what it costs; fillings of the cell that
# are tried; the largest difference from the target; electronegativity and radius (pm) where neither is known.
ANION_SITES = {"O", "F", "Cl", "Br", "I", "S", "Se", "Te", "N", "H"}
SPACERS = {"Sr", "Ca", "Ba", "La", "Y", "Nd", "Pr", "Sm", "Eu", "Gd", "Dy", "Ho", "Er", "Tm", "Yb", "Lu", "Ce", "Tb", "K", "Na", "Rb", "Cs"}
SPACER_FILL, OTHER_FILL, OVERFILL = 0.90, 0.97, 0.02
UNLIKE, FOREIGN = 0.9, 0.25
FILLINGS = (1.0, 0.99, 0.98, 0.97, 0.95, 0.93, 0.90)
TOLERANCE = 0.02
UNKNOWN = (140, 1.5)

_OUT = pa.schema([("formula", pa.string()), ("parent", pa.int64()), ("outcome", pa.string()), ("filling", pa.float64()), ("cost", pa.float64()), ("residual", pa.float64()), ("sublattice", pa.string()), ("element", pa.string()), ("occupancy", pa.float64())])
_LEAST = 1e-6


def transport(cost: np.ndarray, allowed: np.ndarray, supply: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest flows (rows, elements, sites) that place all supply, and whether there are any, for many problems at once.

    A site takes between ``least`` and ``most``. Flows go along the cheapest path with room, again and again; the part of
    a site that must be filled is worth more than any way is long, so it is filled first. All problems take a step
    together, as rows of one array of residual rooms.
    """
    rows, e, p = cost.shape
    n, big = 2 + e + 2 * p, 1e3
    site, must, sink = 1 + e, 1 + e + p, n - 1
    room, price = np.zeros((rows, n, n)), np.zeros((rows, n, n))
    k = np.arange(p)
    room[:, 0, 1:site] = supply
    room[:, 1:site, site:must] = np.where(allowed, np.inf, 0.0)
    room[:, site + k, must + k], room[:, site + k, sink], room[:, must + k, sink] = least, most - least, np.inf
    price[:, 1:site, site:must] = cost
    price[:, site:must, 1:site] = -cost.transpose(0, 2, 1)
    price[:, site + k, must + k], price[:, must + k, site + k] = -big, big
    active = np.arange(rows)
    while len(active):
        far, before = np.full((len(active), n), np.inf), np.zeros((len(active), n), int)
        far[:, 0] = 0
        open_ = np.where(room[active] > 1e-12, price[active], np.inf)
        for _ in range(n - 1):
            ways = far[:, :, None] + open_
            best = ways.argmin(axis=1)
            new = np.take_along_axis(ways, best[:, None, :], axis=1)[:, 0]
            nearer = new < far - 1e-12
            if not nearer.any():
                break
            far, before = np.where(nearer, new, far), np.where(nearer, best, before)
        ok = np.isfinite(far[:, sink])
        active, before = active[ok], before[ok]
        if not len(active):
            break
        line, at, flow = np.arange(len(active)), np.full(len(active), sink), np.full(len(active), np.inf)
        while at.any():
            came = np.where(at > 0, before[line, at], 0)
            flow = np.minimum(flow, np.where(at > 0, room[active, came, at], np.inf))
            at = came
        at = np.full(len(active), sink)
        while at.any():
            came, moved = np.where(at > 0, before[line, at], 0), np.where(at > 0, flow, 0.0)
            room[active, came, at] -= moved
            room[active, at, came] += moved
            at = came
    flows = room[:, site:must, 1:site].transpose(0, 2, 1)
    full = (room[:, 0, 1:site] <= 1e-9).all(axis=1) & (room[:, site + k, must + k] <= 1e-9).all(axis=1)
    return flows, full


def _problem(target: dict[str, float], sites: dict[str, float], e: int, p: int) -> tuple[np.ndarray, ...] | str:
    """The arrays of one pair, padded; or why there is none."""
    if not set(sites) & set(target):
        return "no shared element"
    cations = sum(n for x, n in sites.items() if x not in ANION_SITES), sum(n for x, n in target.items() if x not in ANION_SITES)
    if min(cations) <= 0:
        return "no cation sublattice"
    cost, allowed, supply, least, most = np.zeros((e, p)), np.zeros((e, p), bool), np.zeros(e), np.zeros(p), np.zeros(p)
    for j, (y, n) in enumerate(sites.items()):
        cation = y not in ANION_SITES
        most[j] = n if cation else n * (1 + OVERFILL)
        least[j] = n * (SPACER_FILL if y in SPACERS else OTHER_FILL) if cation else 0.0
        ry, xy = MEASURED.get(y, UNKNOWN)
        for i, x in enumerate(target):
            rx, xx = MEASURED.get(x, UNKNOWN)
            unlike = abs(xx - xy) + abs(rx - ry) / ry
            cost[i, j] = unlike + (0.0 if x == y else FOREIGN)
            allowed[i, j] = (x in ANION_SITES) != cation and (x == y or unlike <= UNLIKE)
    supply[: len(target)] = np.array(list(target.values())) * cations[0] / cations[1]
    return cost, allowed, supply, least, most


def distribute(pairs: list[tuple[dict[str, float], dict[str, float]]]) -> list[tuple[str, float, float, float, dict[tuple[str, str], float]]]:
    """(outcome, filling, cost, residual, occupancy by (sublattice, element)) for each (target, parent), amounts by element."""
    found: list = [("no feasible site distribution", None, None, None, {})] * len(pairs)
    whole = lambda c: {x: v / sum(c.values()) for x, v in sorted(c.items()) if v / sum(c.values()) > _LEAST}
    pairs = [(whole(a), {x: v for x, v in sorted(b.items()) if v > 0}) for a, b in pairs]
    e, p = max((len(a) for a, _ in pairs), default=0), max((len(b) for _, b in pairs), default=0)
    problems = [_problem(a, b, e, p) for a, b in pairs]
    for k, x in enumerate(problems):
        if isinstance(x, str):
            found[k] = (x, None, None, None, {})
    left = [k for k, x in enumerate(problems) if not isinstance(x, str)]
    for filling in FILLINGS:
        if not left:
            break
        cost, allowed, supply, least, most = (np.array([problems[k][i] for k in left]) for i in range(5))
        flows, full = transport(cost, allowed, supply * filling, least, most)
        for k, flow, c in zip(np.array(left)[full], flows[full], cost[full], strict=True):
            target, sites = pairs[k]
            occ = {(y, x): flow[i, j] / n for j, (y, n) in enumerate(sites.items()) for i, x in enumerate(target) if flow[i, j] > _LEAST}
            sums = {y: sum(v for (z, _), v in occ.items() if z == y) for y in sites}
            if not all(sums.values()):
                continue
            occ = {(y, x): v / max(1.0, sums[y]) if y in ANION_SITES else v for (y, x), v in occ.items()}
            got = {x: sum(v * sites[y] for (y, z), v in occ.items() if z == x) for x in target}
            residual = max(abs(v / sum(got.values()) - target[x]) for x, v in got.items())
            found[k] = ("multi_sublattice" if residual <= TOLERANCE else "composition mismatch", filling, float((flow * c).sum()), residual, occ)
        left = [k for k, ok in zip(left, full, strict=True) if not ok]
    return found


def shares(rows: DataFrame) -> DataFrame:
    """(formula, parent, outcome, filling, cost, residual, sublattice, element, occupancy) for rows (formula, parent, comp, pcomp).

    A parent's element is a sublattice of as many sites. The target's cations fill the cation sites, as far as the first
    of ``FILLINGS`` for which there is a way; what is left of anion sites stays empty. An element sits on its own sites
    or on those of a similar one of the same role, the total unlikeness being least (ties in cost may be dealt either way).
    ``residual`` is the largest difference of a share from the target's. A pair without a way is one row that says why.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                formula, parent = part.column("formula").to_pylist(), part.column("parent").to_pylist()
                found = distribute([(dict(a), dict(c)) for a, c in zip(part.column("comp").to_pylist(), part.column("pcomp").to_pylist(), strict=True)])
                out = [(f, p, *x[:4], y, e, v) for f, p, x in zip(formula, parent, found, strict=True) for (y, e), v in (x[4] or {(None, None): None}).items()]
                yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r, strict=True)) for r in out], _OUT)

    known = rows.filter(F.col("comp").isNotNull() & F.col("pcomp").isNotNull() & (F.size("comp") > 0) & (F.size("pcomp") > 0)).select("formula", "parent", "comp", "pcomp")
    return known.mapInArrow(run, "formula string, parent long, outcome string, filling double, cost double, residual double, sublattice string, element string, occupancy double")


@query()
def fn_dope_shares(spark, sf):
    """Occupancies of each formula's parents' sublattices; equal formulas are dealt once."""
    rounded = [F.round(c, 6).alias(c) for c in ("cost", "residual", "occupancy")]
    return pairs(spark, sf, shares).select("id", "parent", "outcome", "filling", *rounded, "sublattice", "element")
