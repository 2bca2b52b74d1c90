"""depguard: dependency-rule checking, repair and table cleaning as Spark DataFrame plans."""

__version__ = "0.1.0"
