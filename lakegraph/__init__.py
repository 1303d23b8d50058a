"""lakegraph: catalog, lineage, search and data-quality jobs as Spark DataFrames."""
