"""Connected components of a graph of links: those of the library, under the name that the corpus operators use."""

from memlake.operators.shared import components

__all__ = ["components"]
