"""voxmill: sparse voxel-field analytics expressed as PySpark DataFrame jobs."""
