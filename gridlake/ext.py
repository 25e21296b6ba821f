"""Extension points: accessors on grids, and encodings for the element store."""

from __future__ import annotations

from collections.abc import Callable

from gridlake.operators.grid import Grid


class _Namespace:
    def __init__(self, name: str, make: Callable):
        self.name, self.make = name, make

    def __get__(self, grid, owner=None):
        """The accessor of a grid, made at its first use. Grids are immutable, so it stays right."""
        if grid is None:
            return self.make
        made = grid.__dict__.setdefault("_namespaces", {})
        if self.name not in made:
            made[self.name] = self.make(grid)
        return made[self.name]


def register_namespace(name: str):
    """Class decorator: the class, made from a grid, becomes the grid's attribute of that name."""
    def put(make):
        if (hasattr(Grid, name) or name in Grid.__dataclass_fields__) and not isinstance(Grid.__dict__.get(name), _Namespace):
            raise AttributeError(f"a grid has {name!r} already")
        setattr(Grid, name, _Namespace(name, make))
        return make
    return put
