"""Find, resolve, pseudonymise and verify personal data in text, as Spark queries."""
