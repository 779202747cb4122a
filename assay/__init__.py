"""assay: data quality, trust and lineage analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame, so Catalyst and AQE
choose the physical plan and nothing is pulled through the driver unless a
docstring says so.
"""

__version__ = "0.1.0"
