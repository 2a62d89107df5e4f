"""voxtally: customer-feedback analytics as PySpark DataFrame operators."""
