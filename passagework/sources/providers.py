"""Registries of implementations by id: document stores, embedders, vector stores."""

from __future__ import annotations

from typing import Generic, TypeVar

from ..errors import InvalidProvider

T = TypeVar("T")


class Providers(Generic[T]):
    """A later registration under the same id replaces the earlier one."""

    def __init__(self, **known: T):
        self._known: dict[str, T] = dict(known)

    def register(self, name: str, provider: T) -> None:
        self._known[name] = provider

    def get(self, name: str) -> T:
        if name not in self._known:
            raise InvalidProvider(name)
        return self._known[name]

    def ids(self) -> list[str]:
        return sorted(self._known)
