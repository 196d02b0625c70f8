"""All registered queries; nothing in the package imports this module back."""

from __future__ import annotations

from geoquarry.plans import analysis, exports, figures, files, geometry, hub, joins, normalisers, outlines, policy, semantics, summaries, territory, themes, tile_archives, transfer  # noqa: F401  they register their queries
from geoquarry.plans.catalog import QUERIES, Query  # noqa: F401
