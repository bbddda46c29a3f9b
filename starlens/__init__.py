"""starlens: product-review analytics expressed as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``
for scalar helpers) so Catalyst sees one declarative plan end to end.
"""

__version__ = "0.1.0"
