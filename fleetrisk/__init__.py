"""Motor-telematics risk, pricing and fraud analytics as Spark DataFrame operators."""
