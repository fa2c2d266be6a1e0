"""PySpark library for document question answering and conversation analytics."""
