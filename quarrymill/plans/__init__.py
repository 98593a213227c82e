from . import catalog, details, extraction, service, composite, lexicon, relations, snapshots  # noqa: F401, I001  those after the first add to the catalog's queries
