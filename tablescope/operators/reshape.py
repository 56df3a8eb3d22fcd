"""Wide → long reshaping used by the profile operators.

``DataFrame.unpivot`` compiles to ``Expand``, which runs inside whole-stage
code generation; an ``inline``/``explode`` of an array of structs is a
``Generate`` that is about eight times slower per produced row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame

def unpivot_structs(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One output row per input row and struct; the struct fields become columns."""
    names = [f"_u{i}" for i in range(len(structs))]
    wide = df.select(*[s.alias(n) for s, n in zip(structs, names)])
    if len(names) == 1:
        return wide.select(f"{names[0]}.*")
    return wide.unpivot([], names, "_var", "_cell").select("_cell.*")
