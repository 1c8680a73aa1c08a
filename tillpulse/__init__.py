"""Online-shop analytics on PySpark: devices, orders, sales and coupon alerts."""
