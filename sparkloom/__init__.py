"""Spark-native analytics over source trees and text corpora."""

__version__ = "0.1.0"
