"""PySpark-native operators over agent trajectories, conversations, catalogues and text corpora."""
