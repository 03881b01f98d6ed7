"""Contact and engagement analytics on Spark, plus training-data operators in the optional ``llm`` subpackage."""
