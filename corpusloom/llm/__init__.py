"""Training-data operators.  Nothing outside this subpackage imports it.

``queries()`` and ``oracle_sql()`` list what ``__spark_entry__.py`` registers.
"""


def queries():
    from . import registry

    return registry.queries()


def oracle_sql():
    from . import registry

    return registry.oracle_sql()
