"""Column functions. All run inside the JVM and never touch Python workers."""
