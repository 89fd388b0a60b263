"""Schemas that drift between files of JSON records: reports every change, and reads all files into one table.

Each file's schema is a tree of keys whose leaves carry a type and a profile of their values. The edit script from
a file's tree to the next one in its stream is the cheapest set of adds, deletes, renames, moves (a rename to
another parent) and retypings. Inner nodes hold no data and cost nothing, so the script is a minimum-cost
assignment between the leaves of both trees. Scripts are compiled into one projection per file: old paths to
column names of the consistent table.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.session import materialise

TYPES = ("string", "number", "boolean", "array")
#: Hashed words of a field's values in its profile.
DIMS = 64
#: Costs of the edit operations; a rename costs by how unlike the values and the names are.
DELETE, ADD, RETYPE = 0.35, 0.35, 0.4
UNLIKE_VALUES, UNLIKE_NAMES = 0.8, 0.2
#: Cost up to which paths of different streams are taken for one column.
SAME = 0.2
MARKS = " -_,.:/T"
_WORD = re.compile(r"[^\W\d_]+|0+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def leaves(record: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Dotted paths and values of the non-null leaves; an array is a leaf."""
    for key, value in record.items():
        if isinstance(value, dict):
            yield from leaves(value, f"{prefix}{key}.")
        elif value is not None:
            yield prefix + key, value


def read_record(payload: str | None) -> dict | None:
    """The record of a line, or None if it is unreadable."""
    try:
        record = json.loads(payload) if payload else None
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


def type_of(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "array" if isinstance(value, list) else "string"


_ZEROS = str.maketrans("123456789", "0" * 9)
_INTEGER = re.compile(r"\s*[+-]?\d+\s*")
_WORDS_AT = 11 + len(MARKS)
_UNHELD_AT = _WORDS_AT + DIMS
#: Types that some values cannot be read as; a string or an array holds any.
PARTIAL = ("number", "boolean")
#: Numbers of a profile: types, sizes, magnitudes, marks, words and what other types cannot hold. Profiles add up.
SIZE = _UNHELD_AT + len(PARTIAL)


class Profiler:
    """Profiles of single values; those of short ones are remembered, up to a bound."""

    def __init__(self) -> None:
        self.buckets: dict[str, int] = {}
        self.known: dict[tuple, np.ndarray] = {}

    def of(self, value: object) -> np.ndarray:
        if isinstance(value, list) or isinstance(value, str) and len(value) > 40:
            return self.make(value)
        key = (type(value), value)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            found = self.known[key] = self.make(value)
        return found

    def make(self, value: object) -> np.ndarray:
        s, kind = [0.0] * SIZE, type_of(value)
        s[TYPES.index(kind)] = 1.0
        text = ",".join(map(str, value)) if kind == "array" else str(value).lower() if kind == "boolean" else str(value)  # type: ignore[call-overload]
        s[4] = math.log1p(len(text))
        number = _number(value)
        if number is not None:
            s[5] = 1.0
            s[6] = math.asinh(100 * number)
            s[7] = float(number == int(number) if abs(number) < 1e15 else 1)
            s[8] = float(number < 0)
        plain = text.translate(_ZEROS)
        for i, mark in enumerate(MARKS):
            s[9 + i] = float(plain.count(mark))
        s[9 + len(MARKS)] = float(plain.count("0"))
        s[10 + len(MARKS)] = float(len(plain))
        buckets = self.buckets
        for w in _WORD.findall(plain.lower()):
            b = buckets.get(w)
            if b is None:
                if len(buckets) > 100_000:
                    buckets.clear()
                b = buckets[w] = _WORDS_AT + zlib.crc32(w.encode()) % DIMS
            s[b] += 1.0
        s[_UNHELD_AT] = 1.0 if kind == "string" and number is None else float(as_type(value, "number") is None)
        s[_UNHELD_AT + 1] = float(as_type(value, "boolean") is None)
        return np.array(s)


def _number(value: object) -> float | None:
    if isinstance(value, bool) or isinstance(value, list):
        return None
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return None
    return x if math.isfinite(x) else None


def field_type(sums: np.ndarray) -> str:
    return TYPES[int(np.argmax(sums[:4]))]


def column_type(sums: np.ndarray) -> str:
    """The type of most values if it holds them all, else string."""
    kind = field_type(sums)
    return "string" if kind in PARTIAL and sums[_UNHELD_AT + PARTIAL.index(kind)] else kind


def values_alike(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how alike two fields' values are."""
    na, nb = a[:4].sum(), b[:4].sum()
    if a[5] > 0.5 * na and b[5] > 0.5 * nb:
        x, y = a / max(a[5], 1), b / max(b[5], 1)
        return math.exp(-abs(x[6] - y[6]) / 2.0) * (1 - 0.5 * abs(x[7] - y[7]) * (min(x[7], y[7]) < 0.6)) * (1 - 0.4 * abs(x[8] - y[8]))
    if (a[5] > 0.5 * na) != (b[5] > 0.5 * nb):
        return 0.0
    x, y = np.sqrt(a[_WORDS_AT:_UNHELD_AT]), np.sqrt(b[_WORDS_AT:_UNHELD_AT])
    cosine = float(x @ y) / (math.sqrt(float(x @ x) * float(y @ y)) or 1.0)
    marks = [z[9 : _WORDS_AT - 1] / max(z[_WORDS_AT - 1], 1.0) for z in (a, b)]
    form = 1 - min(1.0, 2 * float(np.abs(marks[0] - marks[1]).sum()))
    return (cosine + form) / 2 * math.exp(-abs(a[4] / na - b[4] / nb))


def names_alike(a: str, b: str) -> float:
    """0 to 1: shared words of two paths, else of their letters."""
    x, y = ({w.lower() for w in _NAME.findall(n)} for n in (a, b))
    p, q = ({s[i : i + 3] for i in range(len(s) - 2)} for s in ("".join(sorted(x)), "".join(sorted(y))))
    return max(len(x & y) / (len(x | y) or 1), len(p & q) / (len(p | q) or 1))


def cheapest_assignment(cost: np.ndarray) -> list[int]:
    """Column of each row of a square matrix at the least total cost (shortest augmenting paths)."""
    n = len(cost)
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[j0] = True
            reduced = cost[row_of[j0] - 1] - u[row_of[j0]] - v[1:]
            free = ~used[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            step = least[j1]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0], j0 = row_of[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


def edit_script(before: dict[str, np.ndarray], after: dict[str, np.ndarray]) -> list[tuple[str, str, str]]:
    """(change, field, new name) of the cheapest script between two schema trees, given as leaf profiles.

    Leaves are added, removed, renamed, moved under another parent (and perhaps renamed there) or retyped.
    """
    script = [("retyped", f, "") for f in before.keys() & after.keys() if field_type(before[f]) != field_type(after[f])]
    old, new = sorted(before.keys() - after.keys()), sorted(after.keys() - before.keys())
    n = len(old) + len(new)
    over = lambda path: path.rpartition(".")[0]
    if n:
        cost = np.zeros((n, n))
        cost[: len(old), len(new) :] = DELETE
        cost[len(old) :, : len(new)] = ADD
        for i, a in enumerate(old):
            for j, b in enumerate(new):
                unlike = UNLIKE_VALUES * (1 - values_alike(before[a], after[b])) + UNLIKE_NAMES * (1 - names_alike(a, b))
                cost[i, j] = unlike + RETYPE * (field_type(before[a]) != field_type(after[b]))
        for i, j in enumerate(cheapest_assignment(cost)):
            if i < len(old):
                if j < len(new):
                    script.append(("renamed" if over(old[i]) == over(new[j]) else "moved", old[i], new[j]))
                    if field_type(before[old[i]]) != field_type(after[new[j]]):
                        script.append(("retyped", new[j], ""))
                else:
                    script.append(("removed", old[i], ""))
            elif j < len(new):
                script.append(("added", new[j], ""))
    return sorted(script)


def _added_up(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the sums of its rows, and how many they are (``files``), or the sum of that column.

    Sorted runs are added up in numpy, within each task before the shuffle and again after it.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last key, whose rows may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            names = list(zip(*(b.column(k).to_pylist() for k in keys)))
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            sums = np.add.reduceat(b.column("sums").flatten().to_numpy().reshape(-1, SIZE), starts, axis=0)
            files = np.add.reduceat(b.column("files").to_numpy(), starts)
            met = [names[i] for i in starts]
            if held is not None and held[0] == met[0]:
                sums[0] += held[1]
                files[0] += held[2]
            elif held is not None:
                yield batch([held[0]], held[1][None, :], np.array([held[2]]))
            if len(met) > 1:
                yield batch(met[:-1], sums[:-1], files[:-1])
            held = (met[-1], sums[-1], files[-1])
        if held is not None:
            yield batch([held[0]], held[1][None, :], np.array([held[2]]))

    def batch(names: list[tuple], sums: np.ndarray, files: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * SIZE), pa.array(sums.ravel()))
        return pa.record_batch({**{k: pa.array([x[i] for x in names], pa.string()) for i, k in enumerate(keys)}, "sums": lists, "files": pa.array(files.astype(np.int64))})

    schema = ", ".join(f"{k} string" for k in keys) + ", sums array<double>, files bigint"
    rows = profiles.select(*keys, "sums", profiles["files"] if "files" in profiles.columns else F.lit(1).cast("bigint").alias("files"))
    within = rows.sortWithinPartitions(*keys).mapInArrow(add, schema)
    return within.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, schema)


def field_profiles(lines: DataFrame) -> DataFrame:
    """(file_name, path, sums): one profile of each field of each file.

    lines: file_name and payload. Tasks send one partial profile per file and field they met.
    """

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[str, str], np.ndarray] = {}
        values = Profiler()

        def out() -> pa.RecordBatch:
            keys = list(met)
            flat = pa.array(np.concatenate([met[k] for k in keys]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * SIZE), flat)
            return pa.record_batch({"file_name": pa.array([k[0] for k in keys], pa.string()), "path": pa.array([k[1] for k in keys], pa.string()), "sums": lists})

        for b in batches:
            for name, payload in zip(b.column("file_name").to_pylist(), b.column("payload").to_pylist()):
                record = read_record(payload)
                if record is not None and name is not None:
                    for path, value in leaves(record):
                        sums = met.get((name, path))
                        if sums is None:
                            met[name, path] = values.of(value).copy()
                        else:
                            sums += values.of(value)
            if len(met) > 20_000:
                yield out()
                met.clear()
        if met:
            yield out()

    partial = lines.select("file_name", "payload").mapInArrow(profile, "file_name string, path string, sums array<double>")
    return _added_up(partial, ["file_name", "path"]).drop("files")


def file_order(lines: DataFrame) -> DataFrame:
    """(stream, file_name, before): every file with the one before it in its stream, by time, then name."""
    files = lines.filter("file_name is not null").groupBy("file_name").agg(F.min("stream").alias("stream"), F.min("written_at").alias("written_at"))
    order = Window.partitionBy("stream").orderBy(F.col("written_at").asc_nulls_first(), "file_name")
    return files.select("stream", "file_name", F.lag("file_name").over(order).alias("before"))


def schema_changes(lines: DataFrame, profiles: DataFrame | None = None, moves: bool = False) -> DataFrame:
    """(file_name, change, field_name, new_name): every change of a file against the one before it in its stream.

    lines: file_name, stream, written_at, payload. change is added, removed, renamed or retyped; new_name is ''
    unless renamed. A field is a key (dotted path) with a non-null value in any readable record of the file; its
    type is the one most of its values have. Unreadable lines count for nothing, a file without readable lines
    has no fields; the first file of a stream has no changes. Lines delivered twice change nothing. profiles:
    those of the lines, where they are known already. moves: say moved, not renamed, of a field under another parent.
    """
    profiles = profiles if profiles is not None else materialise(field_profiles(lines), "profiles")
    pairs = file_order(lines).filter("before is not null").select("file_name", "before")
    # both trees of a pair meet in one group: as many rows as the two files have fields
    new = pairs.select("file_name", F.col("file_name").alias("of"), F.lit(1).alias("after"))
    old = pairs.select("file_name", F.col("before").alias("of"), F.lit(0).alias("after"))
    trees = new.unionByName(old).join(profiles.withColumnRenamed("file_name", "of"), "of").select("file_name", "after", "path", "sums")

    def script(key: tuple, table: pa.Table) -> pa.Table:
        sides: tuple[dict, dict] = ({}, {})
        for after, path, sums in zip(*(table.column(c).to_pylist() for c in ("after", "path", "sums"))):
            sides[after][path] = np.array(sums)
        rows = [("renamed" if c == "moved" and not moves else c, f, n) for c, f, n in edit_script(*sides)]
        return pa.table({
            "file_name": pa.array([key[0].as_py()] * len(rows), pa.string()),
            **{c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("change", "field_name", "new_name"))},
        })

    return trees.groupBy("file_name").applyInArrow(script, "file_name string, change string, field_name string, new_name string")


def whole_profiles(profiles: DataFrame) -> DataFrame:
    """(path, sums, files): each path's profile over all files, and their number."""
    return _added_up(profiles, ["path"])


class Groups:
    """Paths in groups, each path alone at first; a group goes by one of its paths."""

    def __init__(self, paths: list[str]) -> None:
        self.top, self.members = {p: p for p in paths}, {p: [p] for p in paths}

    def find(self, x: str) -> str:
        while self.top[x] != x:
            x = self.top[x]
        return x

    def join(self, x: str, y: str, apart: set[frozenset] = frozenset()) -> None:  # type: ignore[assignment]
        """Makes the groups of x and y one, unless a path of one is not to be joined with a path of the other."""
        x, y = self.find(x), self.find(y)
        if x != y and not any(frozenset((p, q)) in apart for p in self.members[x] for q in self.members[y]):
            self.top[y] = x
            self.members[x] += self.members.pop(y)


def _together(profiles: DataFrame, links: list[tuple[str, str]], groups: Groups) -> set[frozenset]:
    """Of the paths that the links could join, the pairs that stand in one file: they are two fields."""
    linked = Groups(list(groups.members))
    for x, y in links:
        linked.join(groups.find(x), groups.find(y))
    asked = []
    for tops in linked.members.values():
        paths = [p for t in tops for p in groups.members[t]]
        asked += [(p, q) for i, p in enumerate(paths) for q in paths[i + 1 :]] if len(tops) > 1 else []
    if not asked:
        return set()
    pairs = profiles.sparkSession.createDataFrame(asked, "path string, other string")
    of = profiles.select("file_name", "path")
    both = of.join(pairs, "path").join(of.withColumnRenamed("path", "other"), ["file_name", "other"])
    return {frozenset(r) for r in both.select("path", "other").distinct().collect()}


def column_names(changes: DataFrame, profiles: DataFrame) -> dict[str, tuple[str, str]]:
    """Path -> (column, type) for one kind of record: paths linked by renames, in any stream, are one column.

    So are paths whose values and names, over all files, are alike beyond doubt (cost up to SAME). Paths that stand
    in one file never are: a chain of renames is cut there. The column goes by the path that most files use (ties by
    name, "." as "_", a number behind names that are taken), its type by most values, or string if that type cannot
    hold all of them. Only the distinct paths and renames, i.e. the schema itself, and pairs of the paths that could
    be one column reach the driver.
    """
    found = changes.filter("change = 'renamed'").groupBy("field_name", "new_name").agg(F.count(F.lit(1)).alias("k")).collect()
    used = {r["path"]: (r["files"], np.array(r["sums"])) for r in whole_profiles(profiles).collect()}
    renames = [(r["field_name"], r["new_name"]) for r in sorted(found, key=lambda r: (-r["k"], r["field_name"], r["new_name"])) if r["field_name"] in used and r["new_name"] in used]
    groups = Groups(sorted(used))
    apart = _together(profiles, renames, groups)
    for a, b in renames:
        groups.join(a, b, apart)
    total = {g: sum(used[p][1] for p in paths) for g, paths in groups.members.items()}

    def cost(x: str, y: str) -> float:
        alike = max(names_alike(p, q) for p in groups.members[x] for q in groups.members[y])
        return UNLIKE_VALUES * (1 - values_alike(total[x], total[y])) + UNLIKE_NAMES * (1 - alike)

    of_type: dict[str, list[str]] = defaultdict(list)
    for g in sorted(total):
        of_type[field_type(total[g])].append(g)  # another type costs more than SAME
    alike = sorted((c, x, y) for keys in of_type.values() for i, x in enumerate(keys) for y in keys[i + 1 :] if (c := cost(x, y)) <= SAME)
    apart = _together(profiles, [(x, y) for _, x, y in alike], groups)
    for _, x, y in alike:
        groups.join(x, y, apart)
    out, taken = {}, {"file_name", "line_no"}
    for paths in sorted((min(p, key=lambda x: (-used[x][0], x)), p) for p in groups.members.values()):
        name = first = paths[0].replace(".", "_")
        k = 1
        while name.lower() in taken:
            k += 1
            name = f"{first}_{k}"
        taken.add(name.lower())
        kind = column_type(sum(used[p][1] for p in paths[1]))
        out.update({p: (name, kind) for p in paths[1]})
    return out


def as_type(value: object, kind: str) -> object:
    """The value as the column's type; None where it cannot be read as such."""
    if value is None:
        return None
    if kind == "number":
        if isinstance(value, (bool, float)):
            return float(value)
        x, whole = _number(value), isinstance(value, int) or isinstance(value, str) and _INTEGER.fullmatch(value)
        return None if x is None or whole and int(x) != int(value) else x  # type: ignore[call-overload]
    if kind == "boolean":
        if isinstance(value, str):
            return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(value.strip().lower())
        return bool(value) if value in (0, 1) else None
    if kind == "array":
        return [x if isinstance(x, str) else json.dumps(x) for x in value] if isinstance(value, list) else [x.strip() for x in str(value).split(",")] if str(value).strip() else []
    return ",".join(map(str, value)) if isinstance(value, list) else json.dumps(value) if isinstance(value, bool) else str(value)


def consistent_table(lines: DataFrame, kind: str) -> DataFrame:
    """All readable records of the streams of one kind ("kind/...") in one table, fields under one name and type.

    Columns: file_name, line_no, then the fields by name. A line delivered twice (same file, number and payload)
    counts once; unreadable lines are left out; a field that a record lacks, or has as null, is null. No other value
    becomes null: a column is of a type that holds all its values, string where the type of most of them does not.
    """
    own = lines.filter(F.substring_index("stream", "/", 1) == kind)
    profiles = materialise(field_profiles(own), "profiles")
    names = column_names(schema_changes(own, profiles), profiles)
    columns = sorted(set(names.values()))
    spark_type = {"number": "double", "boolean": "boolean", "array": "array<string>", "string": "string"}
    arrow_type = {"number": pa.float64(), "boolean": pa.bool_(), "array": pa.list_(pa.string()), "string": pa.string()}
    schema = ", ".join(["file_name string", "line_no int", *(f"`{c}` {spark_type[k]}" for c, k in columns)])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, rows = [], []
            for i, payload in enumerate(b.column("payload").to_pylist()):
                record = read_record(payload)
                if record is not None:
                    row: dict[str, object] = {}
                    for path, value in leaves(record):
                        if path in names:
                            column, to = names[path]
                            if row.get(column) is None:
                                row[column] = as_type(value, to)
                    kept.append(i)
                    rows.append(row)
            given = b.take(pa.array(kept, pa.int64()))
            fields = [pa.array([r.get(c) for r in rows], arrow_type[k]) for c, k in columns]
            yield pa.record_batch([given.column("file_name"), given.column("line_no"), *fields], names=["file_name", "line_no", *(c for c, _ in columns)])

    return own.select("file_name", "line_no", "payload").distinct().mapInArrow(project, schema)


def kept_values(lines: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(file_name, records, n_values): what the consistent tables hold of each file, to be held against its lines."""
    out = None
    for kind in kinds:
        t = consistent_table(lines, kind)
        fields = [c for c in t.columns if c not in ("file_name", "line_no")]
        held = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in fields), F.lit(0))
        part = t.groupBy("file_name").agg(F.count(F.lit(1)).alias("records"), F.sum(held).alias("n_values"))
        out = part if out is None else out.unionByName(part)
    return out
