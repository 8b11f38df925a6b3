"""Filters over a DataFrame: paths are resolved against its schema on the driver and become one projection and one filter.

The table's name is the instance name of its rows; columns are leaves, structs containers and arrays of structs lists
of instances. Columns whose name starts with `_` are attributes. Several paths are a union; a path with `!` hides what it
matches, and if all have it, all else is shown. A match inside nested data keeps the key columns of its ancestors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treesift.functions.coerce import Value, compare, field_value, holds, literal, xbool, xnum, xstr
from treesift.functions.library import call
from treesift.plans.ast import Attribute, Binary, Call, Choice, Field, Negate, Not, Number, Path, Self, Step, Text, UnsupportedFeature
from treesift.plans.parser import parse


@dataclass
class Frame:
    """Where a predicate looks its names up."""

    fields: dict[str, Value]
    attributes: dict[str, Value]
    own: Value | None = None
    compat: bool = False
    #: Containers don't take a missing field for ''.
    container: bool = False


def evaluate(node: object, frame: Frame) -> Value:
    """A predicate's node as a value."""
    if isinstance(node, (Number, Text)):
        return literal(node.value)
    if isinstance(node, Field):
        return frame.fields.get(node.name, literal(""))
    if isinstance(node, Attribute):
        return frame.attributes.get(node.name, Value("str", F.lit(None).cast("string"), open=True))
    if isinstance(node, Self):
        return frame.own or literal("")
    if isinstance(node, Call):
        return call(node.name, [evaluate(a, frame) for a in node.args])
    if isinstance(node, Not):
        return Value("bool", ~holds(xbool(evaluate(node.value, frame))))
    if isinstance(node, Negate):
        v = evaluate(node.value, frame)
        if frame.compat:
            return v
        if isinstance(v.literal, (int, float)) and not isinstance(v.literal, bool):
            return literal(-v.literal)
        if v.kind != "int":
            return Value("float", -xnum(v))
        return Value("int", F.coalesce(F.try_subtract(F.lit(0).cast("bigint"), xnum(v).cast("bigint")), F.lit(2**63 - 1)))
    if isinstance(node, Choice):
        test = evaluate(node.condition, frame)
        yes = test if node.yes is None else evaluate(node.yes, frame)
        return call("choose", [test, yes, evaluate(node.no, frame)])
    return _binary(node, frame)


def _binary(node: Binary, frame: Frame) -> Value:
    a, b = evaluate(node.left, frame), evaluate(node.right, frame)
    if node.op == "and":
        return Value("bool", xbool(a) & xbool(b))
    if node.op == "or":
        return Value("bool", xbool(a) | xbool(b))
    if node.op == "_":
        return Value("str", F.concat(xstr(a), xstr(b)))
    if node.op in ("+", "-", "*", "div", "mod"):
        x, y = xnum(a).cast("double"), xnum(b).cast("double")
        if node.op == "div":
            return Value("float", F.try_divide(x, y))
        if node.op == "mod":
            quotient = F.try_divide(x, y)
            rest = x - y * F.coalesce(quotient.try_cast("bigint").cast("double"), quotient)  # beyond 64 bits it has no fraction to cut
            return Value("float", F.when(y == 0, F.lit(0.0)).otherwise(rest))
        return Value("float", {"+": x + y, "-": x - y, "*": x * y}[node.op])
    if frame.compat and any(isinstance(s, Binary) and s.op == "div" for s in (node.left, node.right)):
        void = reduce(lambda p, q: p | q, [v.col.isNull() for v, s in ((a, node.left), (b, node.right)) if isinstance(s, Binary) and s.op == "div"])
        return Value("bool", F.when(void, F.lit(node.op in ("=", "<=", ">="))).otherwise(compare(node.op, a, b, True)))
    return Value("bool", compare(node.op, a, b, frame.compat))


def _names(node: object, kind: type) -> set[str]:
    if isinstance(node, kind):
        return {node.name}
    found: set[str] = set()
    for x in vars(node).values() if hasattr(node, "__dict__") else ():
        for y in x if isinstance(x, tuple) else (x,):
            found |= _names(y, kind)
    return found


def condition(node: object, frame: Frame) -> Column:
    """A predicate as a condition, NULL or false where it fails; attributes that are absent, and fields that a container lacks, fail it."""
    c = xbool(evaluate(node, frame))
    needed = [frame.attributes[n].col for n in sorted(_names(node, Attribute)) if n in frame.attributes]
    if (frame.container or frame.own is not None) and not _names(node, Field) <= set(frame.fields):
        return F.lit(False)
    if frame.container:
        needed += [frame.fields[n].col for n in sorted(_names(node, Field)) if n in frame.fields]
    return reduce(lambda x, y: x & y.isNotNull(), needed, c)


def is_position(node: object) -> bool:
    return isinstance(node, Number)


def _frame(struct: T.StructType, get: Callable[[str], Column], compat: bool, container: bool) -> Frame:
    fields, attributes = {}, {}
    for f in struct.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            continue
        v = field_value(get(f.name), f.dataType)
        (attributes if f.name.startswith("_") else fields)[f.name.removeprefix("_")] = v
    return Frame(fields, attributes, None, compat, container)


def _instances(dtype: T.DataType) -> T.StructType | None:
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return dtype.elementType
    return None


def _index(n: int | float) -> int | None:
    """A position as a list's index from 0; None where no list can have it."""
    return int(n) - 1 if 1 <= n < 2**31 and n == int(n) else None


def _nth(items: Column, n: int | float) -> Column:
    """The n-th of a list in a list of its own, or an empty list."""
    at = _index(n)
    return F.slice(items, 1, 0) if at is None else F.slice(items, at + 1, 1)


def _every_name(dtype: T.DataType) -> set[str]:
    """The names of all fields at any depth."""
    if isinstance(dtype, T.ArrayType):
        return _every_name(dtype.elementType)
    if not isinstance(dtype, T.StructType):
        return set()
    return set(dtype.names).union(*[_every_name(f.dataType) for f in dtype.fields])


class Selector:
    """A compiled filter for one table name; apply() gives the DataFrame of what it lets through."""

    def __init__(self, filters: str | Sequence[str], table: str, keys: Sequence[str] = (), order_by: Sequence[str] = (), within: Sequence[str] = (), compat: bool = False):
        self.paths = [p for f in ([filters] if isinstance(filters, str) else filters) for p in parse(f)]
        self.table, self.keys, self.order_by, self.within, self.compat = table, set(keys), list(order_by), list(within), compat

    def apply(self, df: DataFrame) -> DataFrame:
        return self._chosen(df.drop(*self._closed_early(df)) if self.compat else df)

    def _closed_early(self, df: DataFrame) -> list[str]:
        """With compat: nested columns before the last field that decides a row; they are closed while it is pending, and lost."""
        if len(self.paths) > 1 or self.paths[0].negated or len(self.paths[0].steps) > 1 or self.paths[0].steps[0].name not in (self.table, "*"):
            return []
        asked = {n for p in self.paths[0].steps[0].predicates if not is_position(p) for n in _names(p, Field)}
        last = max((k for k, c in enumerate(df.columns) if c in asked), default=-1)
        nested = (T.StructType, T.ArrayType)
        return [f.name for f in df.schema.fields[: max(0, last)] if isinstance(f.dataType, nested) and (isinstance(f.dataType, T.StructType) or _instances(f.dataType) is not None)]

    def _chosen(self, df: DataFrame) -> DataFrame:
        placed = [p for p in self.paths if p.steps[0].name in (self.table, "*") and any(map(is_position, p.steps[0].predicates))]
        if not placed:
            return self._pruned(df, self.paths)
        if len(self.paths) == 1:
            path = self.paths[0]
            if path.negated and len(path.steps) == 1:
                return self._but(df, self._positions(df, path))
            df = self._positions(df, path)
            if len(path.steps) == 1:
                return df
            return self._pruned(df, [Path((Step(path.steps[0].name), *path.steps[1:]), path.absolute, path.negated)])
        if any(p.negated or len(p.steps) > 1 for p in self.paths):
            raise UnsupportedFeature("positions of rows in a union with nested or negated paths")
        return self._union_of_rows(df, placed)

    def _but(self, df: DataFrame, gone: DataFrame) -> DataFrame:
        """The rows of df that have another place in order_by (and within) than those of gone, which are few or one of a group."""
        names = [*self.order_by, *(n for n in self.within if n not in self.order_by)]
        keys = gone.select(*[F.col(f"`{n}`").alias(f"__g{k}") for k, n in enumerate(names)])
        return df.join(keys, reduce(lambda a, b: a & b, [F.col(f"`{n}`").eqNullSafe(F.col(f"__g{k}")) for k, n in enumerate(names)]), "left_anti")

    def _union_of_rows(self, df: DataFrame, placed: list[Path]) -> DataFrame:
        """Rows that any path takes, each once; order_by must tell rows apart."""
        frame, plain = self._row_frame(df), None
        for p in self.paths:
            if p not in placed and p.steps[0].name in (self.table, "*"):
                c = reduce(lambda x, y: x & y, [condition(q, frame) for q in p.steps[0].predicates], F.lit(True))
                plain = holds(c) if plain is None else plain | holds(c)
        out = df.where(F.lit(False) if plain is None else plain)
        picked: list[DataFrame] = []
        for p in placed:
            rows = self._positions(df, p)
            rows = rows if plain is None else rows.where(~plain)
            for q in picked:
                rows = self._but(rows, q)
            picked.append(rows)
            out = out.unionByName(rows)
        return out

    def _positions(self, df: DataFrame, path: Path) -> DataFrame:
        """Predicates of the row step in turn; a number takes the n-th row, in `order_by`, of what is left (of each group of `within`)."""
        if not self.order_by:
            raise UnsupportedFeature("a position needs order_by: a DataFrame has no order of its own")
        order = [F.col(c) for c in self.order_by]
        for node in path.steps[0].predicates:
            if not is_position(node):
                df = df.where(condition(node, self._row_frame(df)))
            elif node.value < 1 or node.value != int(node.value):
                df = df.where(F.lit(False))
            elif self.within:
                w = Window.partitionBy(*self.within).orderBy(*order)
                df = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == int(node.value)).drop("__n")
            else:  # a bounded top-n, no window over all rows
                df = df.orderBy(*order).limit(int(node.value)).orderBy(*order).offset(int(node.value) - 1)
        return df

    def _row_frame(self, df: DataFrame) -> Frame:
        return _frame(df.schema, lambda n: F.col(f"`{n}`"), self.compat, False)

    def _needed(self, df: DataFrame, paths: Sequence[Path], frame: Frame) -> Column | None:
        """A condition on columns of their own that every row shown meets: the row steps' predicates, if all paths can only start at the rows."""
        names, conditions = _every_name(df.schema), []
        for p in paths:
            first = p.steps[0]
            if p.negated:
                continue
            if first.name != self.table or not first.predicates or (not p.absolute and first.name in names):
                return None
            conditions.append(reduce(lambda a, b: a & b, [condition(q, frame) for q in first.predicates]))
        return reduce(lambda a, b: a | b, conditions) if conditions else None

    def _pruned(self, df: DataFrame, paths: Sequence[Path]) -> DataFrame:
        only_not = all(p.negated for p in paths)
        frame = self._row_frame(df)
        shown, hidden, deeper = self._match(self.table, [(p, 0, None) for p in paths], frame)
        full = F.lit(True) if only_not else shown
        if deeper and (needed := self._needed(df, paths, frame)) is not None:
            df = df.where(needed)  # reaches the scan; inside the nested test it would not
            deeper = [(p, k, None if len(paths) == 1 else c) for p, k, c in deeper]
        if full is None and not deeper and not any(not p.absolute for p in paths):
            return df.where(F.lit(False))
        rest = [*deeper, *[(p, 0, None) for p in paths if not p.absolute]]
        columns, exist, changed, lists = [], [], False, []
        for f in df.schema.fields:
            value, here, same = self._visible(f.name, F.col(f"`{f.name}`"), f.dataType, rest, only_not)
            changed |= not same
            if here is not None and isinstance(f.dataType, T.ArrayType) and self._placed_steps(f.name, rest):
                lists.append(value.alias(f"l{len(lists)}"))
                value = F.col("__lists")[f"l{len(lists) - 1}"]
                here = F.size(value) > 0
            if here is not None:
                exist.append(here)
            columns.append((f.name, value, same))
        keep = None if full is None else full
        for e in exist if not only_not else []:
            keep = e if keep is None else (holds(keep) | holds(e))
        if keep is None:
            return df.where(F.lit(False))
        if lists:  # nothing is pushed through a generator, so these are made once for a row, not again in each condition on them
            df = df.select("*", F.explode(F.array(F.struct(*lists))).alias("__lists"))
        out = df.where(keep) if hidden is None else df.where(holds(keep) & ~holds(hidden))
        if full is not None and not exist and not (only_not and changed):
            return out
        if full is None:
            made = [(n, F.col(f"`{n}`") if value is None else value) for n, value, _ in columns if value is not None or n in self.keys]
        else:
            made = [(n, F.col(f"`{n}`") if same else value if only_not else F.when(holds(full), F.col(f"`{n}`")).otherwise(value if value is not None else (F.col(f"`{n}`") if n in self.keys else F.lit(None)))) for n, value, same in columns]
            if only_not:
                made = [(n, v) for n, v in made if v is not None]
        return out.select(*[v.alias(n) for n, v in made])

    def _match(self, name: str, going: list, frame: Frame, placed: dict | None = None) -> tuple[Column | None, Column | None, list]:
        """(condition to show, condition to hide, continuations) of a node under the paths that may go on here.

        `placed` has the condition of each step with positions; where it lacks one, the node is the only one of its name.
        """
        shown = hidden = None
        deeper = []
        for path, k, so_far in going:
            step = path.steps[k]
            if step.name not in ("*", name):
                continue
            c = so_far
            if placed and (id(path), k) in placed:
                p = placed[id(path), k]
                c = p if c is None else c & p
            else:
                for node in step.predicates:
                    p = F.lit(node.value == 1) if is_position(node) else condition(node, frame)
                    c = p if c is None else c & p
            c = F.lit(True) if c is None else c
            if k + 1 < len(path.steps):
                deeper.append((path, k + 1, c))
            elif path.negated:
                hidden = c if hidden is None else holds(hidden) | holds(c)
            else:
                shown = c if shown is None else shown | c
        return shown, hidden, deeper

    @staticmethod
    def _placed_steps(name: str, going: list) -> list[tuple[Path, int]]:
        """The steps with positions that may match elements of an array of this name."""
        return [(p, k) for p, k, _ in going if p.steps[k].name in ("*", name) and any(map(is_position, p.steps[k].predicates))]

    def _places(self, name: str, col: Column, going: list, test: Callable[[object], Callable[[Column], Column]]) -> dict:
        """For each of these steps: the place, from 0, of the element that its predicates leave in turn, or NULL."""
        found = {}
        for path, k in self._placed_steps(name, going):
            step = path.steps[k]
            first, *rest = step.predicates
            if is_position(first):
                left = F.transform(_nth(col, first.value), lambda x: F.struct(F.lit(_index(first.value) or 0).alias("i"), x.alias("x")))
            else:
                left = F.filter(F.transform(col, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), test(first))
            for node in rest:
                left = _nth(left, node.value) if is_position(node) else F.filter(left, test(node))
            found[id(path), k] = F.get(left, F.lit(0))["i"]
        return found

    @staticmethod
    def _with_places(places: dict, made: Callable[[Callable[[Column], dict]], Column]) -> Column:
        """What `made` gives, with the places found once for the array: it gets a function from an element's place to the steps that take it.

        They are the variable of a lambda over one struct. Named in the lambda over the elements, they would be found anew for each of these.
        """
        once = F.array(F.struct(*[p.alias(f"p{n}") for n, p in enumerate(places.values())]))
        return F.get(F.transform(once, lambda s: made(lambda i: {k: s[f"p{n}"].eqNullSafe(i) for n, k in enumerate(places)})), F.lit(0))

    def _visible(self, name: str, col: Column, dtype: T.DataType, going: list, only_not: bool) -> tuple[Column | None, Column | None, bool]:
        """(value, condition that it is there, whether it is unchanged) of a column or nested field; value None: not shown."""
        anew = [(p, k, c) for p, k, c in going]
        inner = _instances(dtype)
        if inner is not None:
            return self._list(name, col, inner, anew, only_not)
        if isinstance(dtype, T.StructType):
            frame = _frame(dtype, lambda n: col[n], self.compat, True)
            shown, hidden, deeper = self._match(name, anew, frame)
            value, here, same = self._struct(col, dtype, deeper + [(p, 0, None) for p, k, _ in going if k == 0], shown, only_not)
        else:
            own = field_value(col, dtype)
            if isinstance(dtype, T.ArrayType):  # a leaf-list: . is each of its values
                return self._leaf_list(name, col, dtype, anew, only_not)
            frame = Frame({}, {}, own, self.compat)
            shown, hidden, _ = self._match(name, anew, frame)
            value = col if only_not else None if shown is None else F.when(holds(shown), col)
            here, same = (None if only_not else shown), only_not
            if here is not None:
                here = holds(here) & col.isNotNull()
        if hidden is not None:
            unconditional = value is not None and not any(s.predicates for p, _, _ in going for s in p.steps)
            value = None if unconditional else F.when(~holds(hidden), value if value is not None else col)
            same = False
        return value, here, same

    def _struct(self, col: Column, dtype: T.StructType, going: list, shown: Column | None, only_not: bool) -> tuple[Column | None, Column | None, bool]:
        if only_not and not going:
            return col, None, True
        parts, exist, all_same = [], [], True
        for f in dtype.fields:
            value, here, same = self._visible(f.name, col[f.name], f.dataType, going, only_not)
            all_same &= same
            if here is not None:
                exist.append(here)
            if value is not None or f.name in self.keys:
                parts.append((value if value is not None else col[f.name]).alias(f.name))
        if only_not:
            return (col, None, True) if all_same else (F.struct(*parts) if parts else None, None, False)
        some = reduce(lambda a, b: holds(a) | holds(b), exist) if exist else None
        if shown is not None:
            return F.when(holds(shown), col), (holds(shown) if some is None else holds(shown) | some), False
        return (F.struct(*parts), some, False) if some is not None else (None, None, False)

    def _list(self, name: str, col: Column, inner: T.StructType, going: list, only_not: bool) -> tuple[Column | None, Column | None, bool]:
        places = self._places(name, col, going, lambda node: lambda e: holds(condition(node, _frame(inner, lambda c: e["x"][c], self.compat, False))))

        def judged(x: Column, placed: dict) -> tuple[Column | None, Column | None, Column | None]:
            shown, hidden, deeper = self._match(name, going, _frame(inner, lambda c: x[c], self.compat, False), placed)
            value, here, _ = self._struct(x, inner, deeper + [(p, 0, None) for p, k, _ in going if k == 0], shown, only_not)
            return value, here, hidden

        def kept(x: Column, placed: dict) -> Column:
            _, here, hidden = judged(x, placed)
            return holds(here) & (F.lit(True) if hidden is None else ~holds(hidden))

        value, here, hidden = judged(F.col("__probe"), dict.fromkeys(places, F.lit(True)))
        if only_not:
            if hidden is None:
                return col, None, True
            if places:
                return self._with_places(places, lambda at: F.filter(col, lambda x, i: ~holds(judged(x, at(i))[2]))), None, False
            return F.filter(col, lambda x: ~holds(judged(x, {})[2])), None, False
        if value is None or here is None:
            return None, None, False
        if places:
            made = self._with_places(places, lambda at: F.array_compact(F.transform(col, lambda x, i: F.when(kept(x, at(i)), judged(x, at(i))[0]))))
            return made, F.size(made) > 0, False
        found = F.filter(col, lambda x: kept(x, {}))
        return F.transform(found, lambda x: judged(x, {})[0]), F.size(found) > 0, False

    def _leaf_list(self, name: str, col: Column, dtype: T.ArrayType, going: list, only_not: bool) -> tuple[Column | None, Column | None, bool]:
        def own(x: Column) -> Frame:
            return Frame({}, {}, field_value(x, dtype.elementType), self.compat)

        places = self._places(name, col, going, lambda node: lambda e: holds(condition(node, own(e["x"]))))

        def test(x: Column, placed: dict) -> tuple[Column | None, Column | None]:
            shown, hidden, _ = self._match(name, going, own(x), placed)
            return shown, hidden

        def filtered(which: int, keep: bool) -> Column:
            passes = (lambda c: holds(c)) if keep else (lambda c: ~holds(c))
            if places:
                return self._with_places(places, lambda at: F.filter(col, lambda x, i: passes(test(x, at(i))[which])))
            return F.filter(col, lambda x: passes(test(x, {})[which]))

        shown, hidden = test(F.col("__probe"), dict.fromkeys(places, F.lit(True)))
        if only_not:
            return (col, None, True) if hidden is None else (filtered(1, False), None, False)
        if shown is None:
            return None, None, False
        kept = filtered(0, True)
        return kept, F.size(kept) > 0, False


def select(df: DataFrame, filters: str | Sequence[str], table: str, **options) -> DataFrame:
    """What the filters let through; options are those of Selector."""
    return Selector(filters, table, **options).apply(df)
