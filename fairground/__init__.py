"""fairground: event-catalogue analytics as Spark DataFrame operators."""
