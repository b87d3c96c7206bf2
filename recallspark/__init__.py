"""A PySpark-native analytics engine for conversational long-term memory."""
