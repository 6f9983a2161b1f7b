from . import catalogue, further, indexed, more, records, ruled, social  # noqa: F401  (all register their queries)
