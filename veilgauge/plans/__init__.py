"""Registered queries with their SQL twins."""


def all_queries():
    """(queries, oracle texts) of every plan module."""
    import importlib
    import pkgutil

    from . import catalog

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return dict(catalog.QUERIES), catalog.oracle_texts()
