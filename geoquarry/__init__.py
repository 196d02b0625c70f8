"""geoquarry: urban vector analytics and training-data preparation on PySpark."""
