"""Column expressions shared by the operators; nothing here touches a DataFrame."""
