"""millrace: tenant-scoped analytics, knowledge and reliability operators on PySpark."""
