"""Path scopes: folders included and excluded, as range predicates that reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trim(path: str) -> str:
    return path.rstrip("/") if len(path) > 1 else path


def inside(path: str, root: str) -> bool:
    """Strictly inside; the folder itself is not."""
    return path.startswith(root if root.endswith("/") else root + "/")


@dataclass(frozen=True)
class PathScope:
    """Inside any include and no exclude; an exclusion wins; no include means nothing."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, include: Iterable[str], exclude: Iterable[str] = ()) -> PathScope:
        return cls(tuple(map(_trim, include)), tuple(map(_trim, exclude)))

    def contains(self, path: str) -> bool:
        return any(inside(path, r) for r in self.include) and not any(inside(path, r) for r in self.exclude)

    def column(self, path: Column) -> Column:
        """contains() as half-open ranges: "0" follows "/" in byte order."""

        def under(root: str) -> Column:
            base = root.rstrip("/")
            return (path >= base + "/") & (path < base + "0")

        def any_of(roots: tuple[str, ...]) -> Column:
            return reduce(lambda a, b: a | b, map(under, roots), F.lit(False))

        got = any_of(self.include)
        return got & ~any_of(self.exclude) if self.exclude else got

    def focused(self, folder: str) -> PathScope:
        """The narrower of the folder and each include; unrelated includes go."""
        folder = _trim(folder)
        kept = [folder if folder == r or inside(folder, r) else r for r in self.include if folder == r or inside(folder, r) or inside(r, folder)]
        return PathScope(tuple(dict.fromkeys(kept)), self.exclude)

    def shows_folder(self, path: Column) -> Column:
        """The folder is an include, inside one or above one, and no exclude or inside one."""

        def related(root: str) -> Column:
            return (path == root) | path.startswith(root.rstrip("/") + "/") | F.lit(root).startswith(F.concat(F.rtrim(path, F.lit("/")), F.lit("/")))

        shown = reduce(lambda a, b: a | b, map(related, self.include), F.lit(False))
        hidden = reduce(lambda a, b: a | b, ((path == r) | path.startswith(r.rstrip("/") + "/") for r in self.exclude), F.lit(False))
        return (path != "") & shown & ~hidden
