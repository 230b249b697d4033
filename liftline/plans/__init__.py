"""Plans over the given tables: views, registered queries and their SQL twins."""

from __future__ import annotations

from liftline.plans.registry import ENTRIES, Entry


def all_entries() -> dict[str, Entry]:
    from liftline.plans import bodies, checks, pipeline, reads, scalars  # noqa: F401

    return dict(sorted(ENTRIES.items()))
