"""partweave: material-master harmonisation expressed as Spark DataFrame programs."""
