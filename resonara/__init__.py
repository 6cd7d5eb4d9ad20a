"""Resonara: signal decomposition, matching and arrangement as Spark DataFrame operators."""
