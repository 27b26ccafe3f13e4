"""hitlore: recording, searching and analysing HTTP access logs on PySpark."""
