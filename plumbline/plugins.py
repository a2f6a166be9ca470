"""Extensions: manifests, facts that are written once, return types, rules and macros of third parties."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Manifest:
    id: str
    version: str = "0"
    produces: tuple[str, ...] = ()
    consumes: tuple[str, ...] = ()
    options: dict = field(default_factory=dict, hash=False)


class Facts:
    """Values by plugin and name; a name is written once, or again with an equal value."""

    def __init__(self):
        self._values: dict[tuple[str, str], object] = {}

    def publish(self, plugin: str, name: str, value: object) -> None:
        key = plugin, name
        if key in self._values and self._values[key] != value:
            raise ValueError(f"{plugin} has published another {name}")
        self._values[key] = value

    def read(self, plugin: str, name: str) -> object | None:
        return self._values.get((plugin, name))


class Registry:
    """Plugins in the order they were added."""

    def __init__(self):
        self.manifests: list[Manifest] = []
        self.facts = Facts()
        self._prepare: dict[str, Callable[[Facts], None]] = {}
        self._returns: dict[str, Callable[[str], object]] = {}
        self._rules: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self._macros: dict[str, Callable[..., list[str]]] = {}

    def add(self, manifest: Manifest, *, prepare: Callable[[Facts], None] | None = None, return_type: Callable[[str], object] | None = None, rule: Callable[[DataFrame], DataFrame] | None = None) -> None:
        if any(m.id == manifest.id for m in self.manifests):
            raise ValueError(f"{manifest.id} is there already")
        self.manifests.append(manifest)
        for of, f in ((self._prepare, prepare), (self._returns, return_type), (self._rules, rule)):
            if f:
                of[manifest.id] = f

    def add_macro(self, name: str, expand: Callable[..., list[str]]) -> None:
        self._macros[name] = expand

    def prepare(self) -> None:
        for m in self.manifests:
            if m.id in self._prepare:
                self._prepare[m.id](self.facts)

    def return_type(self, call: str) -> object | None:
        """The first answer."""
        return next((t for f in self._returns.values() if (t := f(call)) is not None), None)

    def expand(self, name: str, *args: str) -> list[str]:
        """Members that a macro's call stands for; none for an unknown macro."""
        return self._macros[name](*args) if name in self._macros else []

    def diagnostics(self, df: DataFrame) -> list[DataFrame]:
        from .operators.rules import isolated

        return [isolated(k, f, df) for k, f in self._rules.items()]
