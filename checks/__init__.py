"""The same questions in DuckDB SQL, to check the Spark results against."""
