"""Plans of the registered queries, by family. Importing this package registers them."""

from . import aggregates, fixtures, iterative, joins, legacy, legacy_tables, more, numbers, recognition, relational, score_tables, shapes, windows  # noqa: F401
