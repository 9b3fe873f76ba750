"""The registry of collections, a YAML file."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field

from ..errors import CollectionExists, CollectionNotFound, InvalidName


@dataclass
class Collection:
    name: str
    path: str
    globs: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    description: str | None = None


def check_name(name: str) -> str:
    if not name or "/" in name or "\0" in name or ".." in name:
        raise InvalidName(repr(name))
    return name


class Registry:
    """Collections by name; every change is written through one rename."""

    def __init__(self, path: str) -> None:
        import yaml

        self.path = path
        self.collections: list[Collection] = []
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.collections = [Collection(**c) for c in (yaml.safe_load(f) or {}).get("collections", [])]

    def _save(self) -> None:
        import yaml

        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        rows = [{k: v for k, v in asdict(c).items() if v is not None} for c in self.collections]
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            yaml.safe_dump({"collections": rows}, f, sort_keys=False, allow_unicode=True)
        os.replace(f"{self.path}.new", self.path)

    def get(self, name: str) -> Collection:
        for c in self.collections:
            if c.name == name:
                return c
        raise CollectionNotFound(name)

    def names(self) -> list[str]:
        return [c.name for c in self.collections]

    def add(self, collection: Collection) -> None:
        check_name(collection.name)
        if collection.name in self.names():
            raise CollectionExists(collection.name)
        self.collections.append(collection)
        self._save()

    def remove(self, name: str) -> Collection:
        gone = self.get(name)
        self.collections.remove(gone)
        self._save()
        return gone

    def rename(self, old: str, new: str) -> None:
        """The caller renames the collection's index folder as well."""
        found = self.get(old)
        check_name(new)
        if new in self.names():
            raise CollectionExists(new)
        found.name = new
        self._save()

    def set_path(self, name: str, path: str) -> None:
        found = self.get(name)
        found.path = os.path.realpath(path, strict=True)
        self._save()

    def resolve(self, names: list[str], folder: str) -> list[str]:
        """The named collections; else the one whose path is the longest prefix of ``folder``; else all."""
        if names:
            return [self.get(n).name for n in names]
        folder = os.path.realpath(folder)
        around = [c for c in self.collections if folder == (root := os.path.realpath(c.path)) or folder.startswith(root.rstrip("/") + "/")]
        return [max(around, key=lambda c: len(os.path.realpath(c.path))).name] if around else self.names()
