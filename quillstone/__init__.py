"""quillstone: record linkage and data processing as DataFrame -> DataFrame operators on PySpark."""
