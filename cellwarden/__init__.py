"""cellwarden: cell-level data-quality decisions on Spark DataFrames.

``cellwarden.plans.analyze.analyze`` profiles a table, gathers evidence about
single cells, fuses it and decides per cell whether it is repaired, reviewed
or refused.
"""
