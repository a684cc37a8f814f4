"""Design matrices as column expressions, with levels frozen when fitted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "Manquant"
MAX_LEVELS = 500
#: Columns from which the target is made; as regressors they would be circular.
FORBIDDEN = frozenset({"prix_tnd", "price", "log_price", "log_prix", "gamme_prix", "tier", "cluster_id"})


class CircularityError(ValueError):
    pass


def check_no_circularity(names: Sequence[str]) -> None:
    bad = [n for n in names if n in FORBIDDEN or any(n.startswith(f + "_") for f in ("gamme_prix", "tier", "cluster_id"))]
    if bad:
        raise CircularityError(f"regressors made from the target: {', '.join(sorted(bad))}")


def lineage(df: DataFrame) -> dict[str, set[str]]:
    """Of each column of ``df`` the names of all columns that its value was made from, itself included.

    Read from the analysed plan: attribute ids lead from each alias to what it refers to, through projections, aggregates, windows,
    generators, unions and Python functions over columns. A table that was written and read again begins anew, as does the output of functions
    over whole partitions.
    """
    made: dict[int, set[int]] = {}
    names: dict[int, set[str]] = {}

    def items(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def references(expression) -> set[int]:
        out = set()
        for a in items(expression.references().toSeq()):
            names.setdefault(a.exprId().id(), set()).add(a.name())
            out.add(a.exprId().id())
        return out

    def aliases(expression) -> None:
        if expression.getClass().getSimpleName() == "Alias":
            names.setdefault(expression.exprId().id(), set()).add(expression.name())
            made.setdefault(expression.exprId().id(), set()).update(references(expression))
        for child in items(expression.children()):
            aliases(child)

    def walk(plan) -> None:
        children = items(plan.children())
        kind = plan.getClass().getSimpleName()
        for e in items(plan.expressions()):
            aliases(e)
        if kind == "Union":  # the columns of all branches, by place
            for child in children:
                for a, b in zip(items(plan.output()), items(child.output())):
                    names.setdefault(b.exprId().id(), set()).add(b.name())
                    if a.exprId().id() != b.exprId().id():
                        made.setdefault(a.exprId().id(), set()).add(b.exprId().id())
        elif kind == "Generate":
            for a in items(plan.generatorOutput()):
                made.setdefault(a.exprId().id(), set()).update(references(plan.generator()))
        for child in children:
            walk(child)

    plan = df._jdf.queryExecution().analyzed()
    walk(plan)
    out: dict[str, set[str]] = {}
    for a in items(plan.output()):
        seen, left = set(), {a.exprId().id()}
        while left:
            i = left.pop()
            seen.add(i)
            left |= made.get(i, set()) - seen
        out.setdefault(a.name(), {a.name()}).update(*(names.get(i, set()) for i in seen))
    return out


def check_lineage(df: DataFrame, names: Sequence[str], target: Sequence[str] = ("prix_tnd", "price")) -> None:
    """Refuses regressors whose values were made from the target, whatever they are called now."""
    found = lineage(df)
    bad = [f"{n} (from {', '.join(sorted(found.get(n, set()) & set(target)))})" for n in names if found.get(n, set()) & set(target)]
    if bad:
        raise CircularityError(f"regressors made from the target: {', '.join(sorted(bad))}")


@dataclass
class DesignSpec:
    """Continuous columns as they are, categorical ones as 0/1 columns of all levels but the first.

    A level unseen when fitted has zeros everywhere, as the reference level has; ``drop_first=False`` keeps all levels.
    """

    continuous: list[str]
    categorical: list[str]
    levels: dict[str, list[str]] = field(default_factory=dict)
    drop_first: bool = True

    @classmethod
    def fit(cls, df: DataFrame, continuous: Sequence[str], categorical: Sequence[str], drop_first: bool = True) -> DesignSpec:
        check_no_circularity([*continuous, *categorical])
        check_lineage(df, [*continuous, *categorical])
        levels = {}
        if categorical:
            row = df.agg(*[F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))).alias(c) for c in categorical]).first()
            for c in categorical:
                if len(row[c]) > MAX_LEVELS:
                    raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
                levels[c] = list(row[c])
        spec = cls(list(continuous), list(categorical), levels, drop_first)
        check_no_circularity(spec.names)
        return spec

    @property
    def names(self) -> list[str]:
        return self.continuous + [f"{c}_{x}" for c in self.categorical for x in self.levels[c][int(self.drop_first) :]]

    def columns(self) -> list[Column]:
        out = [F.col(c).cast("double").alias(c) for c in self.continuous]
        for c in self.categorical:
            value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            out += [(value == x).cast("double").alias(f"{c}_{x}") for x in self.levels[c][int(self.drop_first) :]]
        return out

    def vector(self, constant: bool = True) -> Column:
        """All regressors as one array, the constant first."""
        return F.array(*([F.lit(1.0)] if constant else []), *self.columns())
