"""tessera: entity alignment and table analytics as lazy Spark DataFrame operators."""

__version__ = "0.1.0"
