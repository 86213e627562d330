"""strokeframe: line-drawing, raster, tile and sequence analytics as Spark DataFrames."""
