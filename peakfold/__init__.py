"""A PySpark-native analytics engine for tandem mass spectra."""

__version__ = "0.1.0"
