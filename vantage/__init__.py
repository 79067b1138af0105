"""Query by example over grids of local descriptors, and the vector analytics it rests on, as Spark plans."""
