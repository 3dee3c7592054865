"""Declared tasks: an index of YAML files (tasks, groups, tags), registries by name, and plug-ins named by a file's path."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

try:
    import yaml
except ImportError:  # only reading YAML needs it
    yaml = None


class Registry(dict[str, Any]):
    """Objects by name; a name can't be taken twice, and an unknown one is an error that lists what there is."""

    def __init__(self, kind: str) -> None:
        self.kind = kind

    def register(self, *names: str) -> Callable[[Any], Any]:
        def add(thing: Any) -> Any:  # noqa: ANN401
            for name in names:
                if name in self:
                    raise ValueError(f"{self.kind} {name} is registered twice")
                self[name] = thing
            return thing

        return add

    def __missing__(self, name: str) -> Any:  # noqa: ANN401
        raise ValueError(f"unknown {self.kind} {name!r}; there are {', '.join(sorted(self)) or 'none'}")


MODELS, TASKS, GROUPS, REWARD_MANAGERS = Registry("model"), Registry("task"), Registry("group"), Registry("reward manager")


def from_file(path: str, name: str) -> Callable:
    """A function by the path of its Python file and its name, for rewards, hooks and generators of one's own."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    spec = importlib.util.spec_from_file_location(f"plugin_{Path(path).stem}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return getattr(module, name)


def config(path: str | Path) -> dict:
    """A YAML file over those that it includes, the nearest value counting; `!function module.name` is the function of the file module.py beside it."""
    if yaml is None:
        raise ImportError("reading YAML tasks needs the yaml package")
    path = Path(path)

    class Loader(yaml.SafeLoader):
        pass

    def function(_: Loader, node: yaml.Node) -> Callable:
        module, _, name = node.value.rpartition(".")
        return from_file(str(path.parent / f"{module}.py"), name)

    Loader.add_constructor("!function", function)
    own = yaml.load(path.read_text(encoding="utf-8"), Loader) or {}  # noqa: S506 - a safe loader with one more tag
    includes = own.pop("include", [])
    out: dict = {}
    for other in [includes] if isinstance(includes, str) else includes:
        out |= config(path.parent / other)
    return out | own


@dataclass
class Index:
    """tasks and groups by name with their files, and tags with their member tasks."""

    tasks: dict[str, Path] = field(default_factory=dict)
    groups: dict[str, Path] = field(default_factory=dict)
    tags: dict[str, list[str]] = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, kind, member): a row for each task and group, and one for each member of a tag."""
        rows = [(n, "task", None) for n in self.tasks] + [(n, "group", None) for n in self.groups] + [(t, "tag", m) for t, members in self.tags.items() for m in members]
        return spark.createDataFrame(rows, "name string, kind string, member string")


def index(folder: str) -> Index:
    """All YAML files below a folder: with `group` a group, with `task` a task; a file without either is only for inclusion. Names taken twice are an error."""
    out = Index()
    for path in sorted(Path(folder).rglob("*.y*ml")):
        found = config(path)
        for kind, names in (("group", out.groups), ("task", out.tasks)):
            name = found.get(kind)
            if isinstance(name, str):
                if name in out.tasks or name in out.groups:
                    raise ValueError(f"{name} is defined twice, last in {path}")
                names[name] = path
                if kind == "task":
                    tags = found.get("tag", [])
                    for tag in [tags] if isinstance(tags, str) else tags:
                        out.tags.setdefault(tag, []).append(name)
                break
    return out


class Generator(DataSource):
    """Rows that a plug-in makes, as a batch source: format "generated" with the options path, function, schema and partitions.

    The function gets the number of a partition and of all partitions, and yields that partition's rows as tuples.
    """

    @classmethod
    def name(cls) -> str:
        return "generated"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        options = dict(self.options)

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [InputPartition(k) for k in range(int(options.get("partitions", 1)))]

            def read(self, partition: InputPartition) -> Iterator[tuple]:
                yield from from_file(options["path"], options["function"])(partition.value, int(options.get("partitions", 1)))

        return Reader()
