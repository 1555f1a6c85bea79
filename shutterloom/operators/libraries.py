"""Libraries: named sets of included and excluded folders with index options, and the scans they ask for.

A library is a definition of a handful of folders, so it lives on the driver as immutable values; what it selects from the
catalog is a PathScope, a range predicate. ``Registry.frames`` gives the stored form as two small tables.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from shutterloom.operators.scope import PathScope, inside


@dataclass(frozen=True)
class Definition:
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    text: bool = False
    images: bool = False
    videos: bool = False

    @property
    def scope(self) -> PathScope:
        return PathScope.of(self.include, self.exclude)

    def check(self) -> Definition:
        """An error unless there is an include, all folders are absolute and named once, every exclude lies in an include
        and no include in an exclude."""
        if not self.include:
            raise ValueError("a library needs an included folder")
        every = [*self.include, *self.exclude]
        if relative := [p for p in every if not p.startswith("/")]:
            raise ValueError(f"not absolute: {relative[0]}")
        if len({p.rstrip("/") for p in every}) < len(every):
            raise ValueError("a folder is named twice")
        for out in self.exclude:
            if not any(inside(out, p) for p in self.include):
                raise ValueError(f"excluded, but in no included folder: {out}")
        for p in self.include:
            if any(inside(p, out) for out in self.exclude):
                raise ValueError(f"included, but in an excluded folder: {p}")
        return self


@dataclass(frozen=True)
class Folder:
    path: str
    excluded: bool
    requested: int = 0
    completed: int = 0
    outcome: str | None = None

    @property
    def pending(self) -> bool:
        return not self.excluded and self.requested > self.completed


@dataclass(frozen=True)
class Library:
    library_id: int
    definition: Definition
    folders: tuple[Folder, ...] = ()
    sequence: int = 0
    import_key: str | None = None

    def _with(self, definition: Definition, again: set[str]) -> Library:
        """The folders of a definition: those that stay keep their counters; new includes and those of ``again`` get a fresh
        number, one that no folder had before."""
        known = {(f.path.rstrip("/"), f.excluded): f for f in self.folders}
        sequence, folders = self.sequence, []
        for path, excluded in [*((p, False) for p in definition.include), *((p, True) for p in definition.exclude)]:
            old = known.get((path.rstrip("/"), excluded))
            now = replace(old, path=path) if old else Folder(path, excluded)
            if not excluded and (old is None or path in again):
                sequence += 1
                now = replace(now, requested=sequence, outcome=None)
            folders.append(now)
        return replace(self, definition=definition, folders=tuple(folders), sequence=sequence)

    def updated(self, definition: Definition) -> Library:
        """Under a new definition. Scanned again are new includes, includes that hold a folder no longer excluded, and all
        of them when an index is switched on."""
        definition.check()
        if definition == self.definition:
            return self
        old = self.definition
        switched = (definition.text and not old.text) or (definition.images and not old.images) or (definition.images and definition.videos and not (old.images and old.videos))
        kept = {p.rstrip("/") for p in definition.exclude}
        shown = [p for p in old.exclude if p.rstrip("/") not in kept]
        return self._with(definition, {p for p in definition.include if switched or any(inside(s, p) for s in shown)})

    def respelled(self, spellings: Mapping[str, str]) -> Library:
        """With other spellings of its folders, counters kept; unchanged if the definition would not hold."""
        new = {a: b for a, b in spellings.items() if a != b}
        name = lambda p: new.get(p, p)
        definition = replace(self.definition, include=tuple(map(name, self.definition.include)), exclude=tuple(map(name, self.definition.exclude)))
        if definition == self.definition:
            return self
        try:
            definition.check()
        except ValueError:
            return self
        return replace(self, definition=definition, folders=tuple(replace(f, path=name(f.path)) for f in self.folders))

    def scanned(self, path: str, request: int, outcome: str = "complete") -> Library:
        """A scan that answers a request; an older one than is known changes nothing."""
        done = lambda f: replace(f, completed=max(f.completed, request), outcome=outcome if request >= f.completed else f.outcome)
        return replace(self, folders=tuple(done(f) if f.path == path and not f.excluded and request <= f.requested else f for f in self.folders))


@dataclass(frozen=True)
class Registry:
    """All libraries, as a value: every change gives a new one."""

    libraries: tuple[Library, ...] = ()
    last_id: int = 0

    def get(self, library_id: int) -> Library | None:
        return next((x for x in self.libraries if x.library_id == library_id), None)

    def create(self, definition: Definition, import_key: str | None = None) -> tuple[Registry, Library]:
        """A repeated import key gives the library it made the first time."""
        definition.check()
        if import_key is not None and (known := next((x for x in self.libraries if x.import_key == import_key), None)):
            return self, known
        new = Library(self.last_id + 1, definition, import_key=import_key)._with(definition, set())
        return Registry((*self.libraries, new), self.last_id + 1), new

    def put(self, library: Library) -> Registry:
        return replace(self, libraries=tuple(library if x.library_id == library.library_id else x for x in self.libraries))

    def delete(self, library_id: int) -> Registry:
        """Catalogued files and what is derived from them stay."""
        return replace(self, libraries=tuple(x for x in self.libraries if x.library_id != library_id))

    def covering(self, without: int) -> list[PathScope]:
        """The scopes of the other libraries."""
        return [x.definition.scope for x in self.libraries if x.library_id != without]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """libraries (library_id, scan_sequence, options, import_key) and folders (library_id, path, position, counters)."""
        heads = [(x.library_id, x.sequence, x.definition.text, x.definition.images, x.definition.videos, x.import_key) for x in self.libraries]
        rows = [(x.library_id, f.path, f.excluded, i, f.requested, f.completed, f.outcome) for x in self.libraries for i, f in enumerate(x.folders)]
        return (
            spark.createDataFrame(heads, "library_id long, scan_sequence long, index_text boolean, index_images boolean, index_videos boolean, import_key string"),
            spark.createDataFrame(rows, "library_id long, path string, excluded boolean, position int, scan_requested long, scan_completed long, scan_outcome string"),
        )


@dataclass(frozen=True)
class ScanRequest:
    pending_only: bool = True
    full: bool = False
    force: bool = False
    retry_failed: bool = False
    max_dimensions: int | None = None
    limit: int | None = field(default=None)

    def merged(self, later: ScanRequest) -> ScanRequest:
        """Of two waiting requests one that does what either asks for; limits are the later one's where it names them."""
        return ScanRequest(
            self.pending_only and later.pending_only,
            self.full or later.full,
            self.force or later.force,
            self.retry_failed or later.retry_failed,
            self.max_dimensions if later.max_dimensions is None else later.max_dimensions,
            self.limit if later.limit is None else later.limit,
        )
