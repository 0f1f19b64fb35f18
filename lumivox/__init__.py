"""Spark-native analytics over imaging cohorts: voxels, masks, headers, annotations and audit trails as tables."""
