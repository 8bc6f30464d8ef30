"""Queries over the driver's tables and their SQL; importing the package registers all of them."""

from ledgerline.plans import histories, lifecycle, oracles, queries, records, sagas, stores  # noqa: F401
