"""Schemas that drift between versions of a file: changes of layout, and one consistent table.

Every version is profiled per field: which JSON kinds its values have, and a value sketch. The
sketch keeps the values of the spikes whose hashed ids are smallest, the same ids in every version,
so two versions can be compared value by value whatever their size. Fields that vanish and fields
that appear are matched by a maximum-weight bipartite matching on value agreement (equal, scaled,
recoded or reformatted values) and name similarity.
"""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

SKETCH = 256
#: Salts a version's lines are spread over before its sketch is cut, so that one version may hold most lines.
SALTS = 16


def parse_lines(exports: DataFrame, id_field: str = "spk_id") -> DataFrame:
    """(export_id, recording_id, ver_no, line_no, spk, field, kind, v): one row per field of each readable line.

    A line is readable if it is a whole JSON object. kind is string, number, boolean, object, array or
    null; v is the value as text. Whole and fractional numbers are one kind. Names keep their case.
    """
    parsed = exports.select("export_id", "recording_id", "ver_no", "line_no", F.try_parse_json("payload").alias("doc"))
    parsed = parsed.filter("doc is not null and schema_of_variant(doc) like 'OBJECT%'")
    parsed = parsed.withColumn("spk", F.try_variant_get("doc", f"$.{id_field}", "string"))
    rows = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("doc").outer())) if hasattr(parsed, "lateralJoin") else parsed
    kind = F.schema_of_variant("value")
    kind = (
        F.when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("number")
    )
    return rows.select("export_id", "recording_id", "ver_no", "line_no", "spk", F.col("key").alias("field"), kind.alias("kind"), F.try_variant_get("value", "$", "string").alias("v"))


def profiles(lines: DataFrame) -> DataFrame:
    """(export_id, recording_id, ver_no, field, kinds, sketch): one row per version and field."""
    key = ["export_id", "recording_id", "ver_no", "field"]
    kinds = lines.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))).alias("kinds"))
    held = lines.filter("kind != 'null' and spk is not null").groupBy(*key, "spk").agg(F.min("v").alias("v"), F.min("kind").alias("kind"))
    held = held.withColumn("h", F.xxhash64("spk")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    first = Window.partitionBy(*key, "salt").orderBy("h", "spk")
    then = Window.partitionBy(*key).orderBy("h", "spk")
    kept = held.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SKETCH).withColumn("r", F.row_number().over(then)).filter(F.col("r") <= SKETCH)
    sketch = kept.groupBy(*key).agg(F.collect_list(F.struct("spk", "v", "kind")).alias("sketch"))
    cond = None
    k, s = kinds.alias("k"), sketch.alias("s")
    for c in key:
        e = F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}"))
        cond = e if cond is None else cond & e
    return k.join(s, cond, "left").select("k.*", "s.sketch")


def _number(v: str):
    try:
        return float(v)
    except (TypeError, ValueError):
        pass
    m = re.fullmatch(r"\s*([-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?)\s*[^\d\s].{0,7}", v or "")
    return float(m[1].replace(",", ".")) if m else None


def _leaves(values: dict[str, str], nested: bool) -> dict[str, dict[str, str]]:
    """The series a field consists of by path: itself, or every leaf of its objects and arrays."""
    if not nested:
        return {"": values}
    out: dict[str, dict[str, str]] = {}

    def walk(path, x, k):
        if isinstance(x, dict):
            for name, y in x.items():
                walk(f"{path}.{name}", y, k)
        elif isinstance(x, list):
            for i, y in enumerate(x):
                walk(f"{path}[{i}]", y, k)
        elif x is not None:
            out.setdefault(path, {})[k] = x if isinstance(x, str) else json.dumps(x)

    for k, v in values.items():
        try:
            walk("", json.loads(v), k)
        except ValueError:
            out.setdefault("", {})[k] = v
    return out or {"": {}}


def agreement(old: tuple, new: tuple) -> float:
    """Best agreement of any series of one profile (kinds, sketch) with any of the other."""
    pairs = [(a, b) for a in _leaves(old[1], _nested(old[0])).values() for b in _leaves(new[1], _nested(new[0])).values()]
    return max(_agreement(a, b) for a, b in pairs)


def _nested(kinds) -> bool:
    return bool({"object", "array"} & set(kinds))


def leaf_conversion(old: tuple, new: tuple) -> dict | None:
    """``conversion`` of two profiles; of a field nested on one side the leaf that agrees best counts, under 'path' (new) or 'old_path'."""
    if _nested(old[0]) == _nested(new[0]):
        return conversion(old[1], new[1])
    path, a, b = max(((p, x, y) for p, x, y in _leaf_pairs(old, new)), key=lambda t: (_agreement(t[1], t[2]), t[0]))
    return (conversion(a, b) or {}) | {"path" if _nested(new[0]) else "old_path": path}


def _leaf_pairs(old: tuple, new: tuple):
    if _nested(new[0]):
        return [(p, old[1], y) for p, y in _leaves(new[1], True).items()]
    return [(p, x, new[1]) for p, x in _leaves(old[1], True).items()]


def _agreement(old: dict[str, str], new: dict[str, str]) -> float:
    """How well the values of the same spikes agree, from 0 to 1: equal, scaled, recoded or reformatted."""
    common = [k for k in old if k in new]
    if not common:
        return 0.0
    a, b = [old[k] for k in common], [new[k] for k in common]
    n = len(common)
    best = float(np.mean([x == y for x, y in zip(a, b)]))
    if len(set(a)) > 1:  # a constant agrees with any constant
        x, y = [_number(v) for v in a], [_number(v) for v in b]
        both = [(p, q) for p, q in zip(x, y) if p is not None and q is not None]
        if len(both) >= max(2, 0.9 * n):
            p, q = (np.array(v, float) for v in zip(*both))
            best = max(best, float(np.mean(np.isclose(p, q, rtol=1e-6, atol=1e-9))))
            nz = (p != 0) & (np.abs(p) > 1e-3 * np.abs(p).max())
            if nz.sum() >= 2 and len(set(p[nz])) > 1:
                ratio = float(np.median(q[nz] / p[nz]))
                if ratio and np.isfinite(ratio):
                    close = np.isclose(q, ratio * p, rtol=2e-3, atol=0.02 * np.abs(q).max() * 0.05)
                    best = max(best, 0.98 * float(np.mean(close)))
            if len(set(p)) >= 4:  # an affine or rounded change of notation
                c = np.corrcoef(p, q)[0, 1] if q.std() else 0
                if c > 0.99999:
                    best = max(best, 0.95)
    else:
        best *= 0.6
    pairs = set(zip(a, b))
    if len(set(a)) > 1 and len(set(a)) == len(set(b)) == len(pairs) and len(pairs) <= 0.7 * n:
        best = max(best, 0.96)  # one code for each label
    return best


def conversion(old: dict[str, str], new: dict[str, str]) -> dict | None:
    """How values under the new name turn into those under the old one: {'factor': f}, {'codes': {new: old}}, or None if they are equal or unlike."""
    pairs = [(old[k], new[k]) for k in old if k in new]
    if not pairs or np.mean([a == b for a, b in pairs]) >= 0.9:
        return None
    numbers = [(p, q) for p, q in ((_number(a), _number(b)) for a, b in pairs) if p is not None and q is not None]
    if len(numbers) >= max(2, 0.9 * len(pairs)):
        p, q = (np.array(v, float) for v in zip(*numbers))
        use = (q != 0) & np.isfinite(p) & np.isfinite(q)
        if use.any():
            ratio = float(np.median(p[use] / q[use]))
            if ratio and np.mean(np.isclose(p[use], ratio * q[use], rtol=5e-3)) >= 0.9:
                # units differ by round factors; what rounding blurs is put right
                power = 10.0 ** round(np.log10(abs(ratio))) * np.sign(ratio)
                return {"factor": float(power) if abs(ratio / power - 1) < 2e-3 else ratio}
        return None
    codes: dict[str, str] = {}
    for a, b in pairs:
        if codes.setdefault(b, a) != a:
            return None
    return {"codes": codes} if len(codes) <= 0.7 * len(pairs) else None


def _tokens(name: str) -> set[str]:
    return set(re.findall(r"[a-z]+|\d+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()))


def name_similarity(a: str, b: str) -> float:
    x, y = _tokens(a), _tokens(b)
    return 0.5 * len(x & y) / max(1, len(x | y)) + 0.5 * SequenceMatcher(None, a.lower(), b.lower()).ratio()


def best_matching(weight: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching by shortest augmenting paths; pairs of weight 0 are left out."""
    n, m = weight.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = -weight
    u, v, p, way = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        p[0], j0 = i, 0
        least, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            i0 = p[j0]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[i0, free] - u[i0] - v[free]
            better = slack < least[free]
            least[free[better]] = slack[better]
            way[free[better]] = j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[p[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    return [(p[j] - 1, j - 1) for j in range(1, size + 1) if 0 < p[j] <= n and j <= m and weight[p[j] - 1, j - 1] > 0]


def _compare(old: dict, new: dict) -> list[tuple]:
    """Changes from one version's profile to the next, renamed ones with their conversion; a profile is {field: (kinds, sketch)}."""
    gone, came = sorted(set(old) - set(new)), sorted(set(new) - set(old))
    out, renamed = [], {}
    if gone and came:
        weight = np.zeros((len(gone), len(came)))
        for i, a in enumerate(gone):
            for j, b in enumerate(came):
                values, names = agreement(old[a], new[b]), name_similarity(a, b)
                thin = len(set(old[a][1]) & set(new[b][1])) < 3
                if values >= 0.9 or (values >= 0.5 and names >= 0.5) or (thin and names >= 0.6):
                    weight[i, j] = values + 0.2 * names
        renamed = {gone[i]: came[j] for i, j in best_matching(weight)}
    for a, b in renamed.items():
        how = leaf_conversion(old[a], new[b])
        out.append(("renamed", a, b, json.dumps(how, sort_keys=True) if how else None))
        if old[a][0] and new[b][0] and old[a][0] != new[b][0]:
            out.append(("retyped", a, b))
    out += [("removed", a, "") for a in gone if a not in renamed]
    out += [("added", "", b) for b in came if b not in renamed.values()]
    for f in set(old) & set(new):
        if old[f][0] and new[f][0] and old[f][0] != new[f][0]:
            out.append(("retyped", f, f))
    return out


_CHANGE = pa.schema([("export_id", pa.int64()), ("change_kind", pa.string()), ("old_field", pa.string()), ("new_field", pa.string()), ("conversion", pa.string())])


def _changes_of(table: pa.Table) -> pa.Table:
    profile: dict[str, dict] = {"old": {}, "new": {}}
    export = None
    for r in table.to_pylist():
        profile[r["role"]][r["field"]] = (tuple(r["kinds"]), {x["spk"]: x["v"] for x in r["sketch"] or []})
        export = r["export_id"] if r["role"] == "new" else export
    rows = _compare(profile["old"], profile["new"]) if profile["old"] and profile["new"] else []
    return pa.Table.from_pylist([dict(zip(_CHANGE.names, (export, *r, *[None] * (4 - len(r))))) for r in rows], schema=_CHANGE)


def layout_changes(lines: DataFrame) -> DataFrame:
    """(export_id, change_kind, old_field, new_field, conversion) between each version and the one before it.

    Versions whose predecessor (ver_no one lower, same recording) is absent or has no readable line
    give no rows. A field belongs to a version if any readable line has it, null or not. Kinds are
    compared over non-null values; a field without any is never 'retyped'. Repeated lines change
    nothing. ``conversion`` is how a renamed field's new values turn into its old ones (JSON; null if they are the
    same). An empty table gives no rows.
    """
    p = materialize(profiles(lines), "profiles")
    roles = F.array(F.struct(F.lit("new").alias("role"), F.col("ver_no").alias("to")), F.struct(F.lit("old").alias("role"), (F.col("ver_no") + 1).alias("to")))
    # a comparison sees two versions' fields with their bounded sketches, never their lines
    both = p.select("*", F.inline(roles))
    return both.groupBy("recording_id", "to").applyInArrow(_changes_of, "export_id long, change_kind string, old_field string, new_field string, conversion string")


def canonical_names(changes: DataFrame, lines: DataFrame) -> dict[str, tuple[str, float | None, dict[str, str] | None, str]]:
    """{field: (name, factor, codes, path)}: one name for all names that a field has had, its most used one, and how values get there.

    Of several conversions between two names the most frequent one counts. The number of distinct field names
    bounds what reaches the driver.
    """
    uses = {r["field"]: r["n"] for r in lines.groupBy("field").agg(F.countDistinct("export_id").alias("n")).collect()}
    votes = changes.filter("change_kind = 'renamed'").groupBy("old_field", "new_field", "conversion").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("old_field", "new_field").agg(F.max_by("conversion", F.struct("n", "conversion")).alias("how"), F.sum("n").alias("n")).collect()
    steps: dict[str, list[tuple[str, float | None, dict | None, str]]] = {f: [] for f in uses}
    for r in sorted(best, key=lambda r: (-r["n"], r["old_field"], r["new_field"])):
        how = json.loads(r["how"]) if r["how"] else {}
        factor, codes = how.get("factor"), how.get("codes")
        steps[r["old_field"]].append((r["new_field"], factor, codes, how.get("path", "")))
        steps[r["new_field"]].append((r["old_field"], 1 / factor if factor else None, {b: a for a, b in codes.items()} if codes else None, how.get("old_path", "")))
    names: dict[str, tuple[str, float | None, dict | None, str]] = {}
    for root in sorted(uses, key=lambda f: (-uses[f], f)):
        if root in names:
            continue
        names[root] = (root, None, None, "")
        queue = [root]
        while queue:
            at = queue.pop(0)
            _, factor, codes, _ = names[at]
            for other, f, c, path in steps[at]:  # ``f`` and ``c`` lead from the other name to this one
                if other not in names:
                    through = {b: codes.get(a, a) if codes else a for b, a in c.items()} if c else codes
                    names[other] = (root, f * (factor or 1.0) if f else factor, through, path)
                    queue.append(other)
    return names


def unified_table(lines: DataFrame, names: dict[str, tuple[str, float | None, dict[str, str] | None, str]]) -> DataFrame:
    """One row per readable line, all versions' fields under their canonical names, in one unit and notation.

    A column is a bigint or double if all its values are such numbers, else text. Where a line has several fields of one name
    whose values differ, the one that bears the name itself counts (else the first by name) and all stand in
    ``conflicts``, a map from column to its values by field.
    """
    spark = lines.sparkSession
    rows = [(f, n, k, c or {}, f"${p}" if p else None) for f, (n, k, c, p) in sorted(names.items())]
    mapping = spark.createDataFrame(rows, "field string, name string, factor double, codes map<string,string>, path string")
    leaf = F.when(F.col("path").isNotNull(), F.coalesce(F.expr("get_json_object(v, path)"), F.col("v"))).otherwise(F.col("v"))
    lines = lines.join(F.broadcast(mapping), "field").withColumn("v", leaf)
    number = F.regexp_extract(F.regexp_replace("v", ",", "."), r"^\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)", 1).try_cast("double")
    plain = F.when(F.col("kind") != "null", F.col("v"))
    scaled = F.coalesce((number * F.col("factor")).cast("string"), plain)
    value = F.when(F.size("codes") > 0, F.coalesce(F.try_element_at("codes", plain), plain)).when(F.col("factor").isNotNull() & plain.isNotNull(), scaled).otherwise(plain)
    named = materialize(lines.withColumn("value", value).filter("value is not null").select("export_id", "recording_id", "ver_no", "line_no", "field", "name", "value"), "named")
    # one row per name
    kinds = named.groupBy("name").agg(F.max(F.col("value").try_cast("double").isNull()).alias("text"), F.max(~F.col("value").rlike(r"^[-+]?\d{1,18}$")).alias("fraction")).collect()
    types = {r["name"]: "string" if r["text"] else "double" if r["fraction"] else "bigint" for r in kinds}
    cols = sorted({n for n, *_ in names.values()})
    own = F.struct((F.col("field") != F.col("name")).alias("other"), "field", "value")
    per = named.groupBy("export_id", "recording_id", "ver_no", "line_no", "name").agg(F.min(own)["value"].alias("value"), F.countDistinct("value").alias("k"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", "value")))).alias("all"))
    pick = [F.max(F.when(F.col("name") == c, F.col("value").try_cast(types.get(c, "string")))).alias(c) for c in cols]
    clash = F.map_from_entries(F.collect_list(F.when(F.col("k") > 1, F.struct("name", "all"))))
    return per.groupBy("export_id", "recording_id", "ver_no", "line_no").agg(*pick, clash.alias("conflicts"))
