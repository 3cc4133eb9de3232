"""Connected components: what linked documents are labelled with."""

from quern.operators.components import components

__all__ = ["components"]
