"""Folioscope: review analytics over large text collections as ordinary Spark DataFrames."""
