"""Shell numbering of vertex pairs: stable when vertices are appended."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shell_index(src: Column, dst: Column) -> Column:
    shell = F.greatest(src, dst)
    return F.when(dst == shell, shell * shell + src).otherwise(shell * shell + 2 * shell - dst)


def shell_pair(e: Column) -> Column:
    """struct(src, dst); the root is corrected in integers."""
    root = F.floor(F.sqrt(e.cast("double"))).cast("long")
    root = F.when(root * root > e, root - 1).when((root + 1) * (root + 1) <= e, root + 1).otherwise(root)
    rest = e - root * root
    return F.struct(F.when(rest <= root, rest).otherwise(root).alias("src"), F.when(rest <= root, root).otherwise(2 * root - rest).alias("dst"))


def shell_size(n: Column) -> Column:
    """Indices of all pairs of n vertices."""
    return n * n


def shell_growth(n: Column) -> Column:
    """Indices that one more vertex adds behind those of n vertices; none of theirs changes."""
    return 2 * n + 1
