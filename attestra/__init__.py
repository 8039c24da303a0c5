"""attestra: document-evidence analytics and training-data preparation as Spark DataFrames."""
