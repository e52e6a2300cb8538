"""The domain tables in DuckDB SQL, from FIXTURES.md; codes widen for numbers longer than their padding."""

from __future__ import annotations

import re


def _padded(number: str, width: int) -> str:
    return f"lpad(cast({number} as varchar), cast(greatest({width}, length(cast({number} as varchar))) as int), '0')"


_PART_CODE = "'P' || " + _padded("(p_partkey - p_partkey % 4)", 6)
_BRAND = "lpad(substr(p_brand, 7), 2, '0')"
_VENDOR = "'V' || " + _padded("s_suppkey", 4)
_LISTING_SKU = f"'1' || {_BRAND} || '-' || cast(p_partkey as varchar)"

# Names that the clean-up leaves alone.
KEPT = """['HC Womens Sleeveless T-Shirts, Round-Bottom', 'MP Instant Hand Saniziter (70% Ethanol, 500ml (16.9oz))',
    'WO Hand Gel Sanitizer (72% Ethanol, 500ml (16.9oz))', 'Reusable Cotton/Spandex Mask - Black, 3P',
    'PI Mens Super Slim Stretch Jeans PMD040023R, PMD029023R', 'SM Mens Premium Cargo Shorts (30-42), blue',
    'Mens Crew Neck Short Sleeve T Shirts, blue', 'Unisex Fleece Sweat Shorts, blue', 'Mens Twill Cargo Shorts with Belt (30-40), blue',
    'Womens Fur Lined Belted Coat (GJ1133), blue']"""

VIEWS: dict[str, str] = {
    "inv_market": """
        select n_nationkey + 1 as MARKET_ID, n_name as BRAND_NAME, r_name as CHANNEL_NAME,
               'market_' || cast(n_nationkey + 1 as varchar) as MARKET_IMAGE_PATH
        from nation join region on n_regionkey = r_regionkey""",
    "inv_inventory": f"""
        select p_partkey as PARTKEY,
               case when p_partkey % 13 = 0 then 'N' || cast(p_partkey as varchar)
                    else {_PART_CODE} || '-C' || cast(p_partkey % 4 as varchar) || '-S' || cast(p_size as varchar) end as STD_SKU,
               case p_partkey % 5 when 0 then p_name || ' Size: ' || cast(p_size as varchar)
                    when 1 then p_name || ' (blue, L), extra' when 2 then p_name || ', no paren'
                    when 3 then if(p_partkey % 25 = 3, {KEPT}[cast((p_partkey - 3) // 25 % 10 as int) + 1], p_name)
                    else p_name end as PRODUCT_NAME,
               p_brand as PRODUCT_SUPPLIER, 'RAW' || cast(p_size as varchar) as PRODUCT_SIZE,
               case when p_partkey % 9 = 0 then null else cast(p_size as varchar) end as SIZE_CODE,
               case p_partkey % 4 when 0 then 'RED' when 1 then p_type || '_dark navy' when 2 then 'A_B_' || p_type
                    else p_type || if(p_partkey % 20 = 3, '_ ', '_ green ') end as PRODUCT_COLOR,
               p_type as PRODUCT_DESIGN, case when p_partkey % 17 = 0 then 'N' else 'Y' end as VALID_YN
        from part""",
    "inv_std_size": """
        select distinct cast(p_size as varchar) as SIZE_CODE, 'S' || cast(p_size as varchar) as SHORT_SIZE_CODE,
               'Size ' || cast(p_size as varchar) as SIZE_NAME, p_size as SIZE_ORDER
        from part where p_size <= 40""",
    "inv_brand": f"""
        select distinct {_BRAND} as BRAND_CODE, p_brand as BRAND_NAME,
               case when p_brand = 'Brand#3' then null else p_brand || '@example.test' end as EMAIL, '' as ORDERS_FROM
        from part""",
    "inv_vendor": f"""
        select {_VENDOR} as VENDOR_CODE, s_name as VENDOR_NAME, s_name || '@example.test b@example.test' as VENDOR_EMAIL,
               case when s_suppkey % 3 = 0 then '' else 'Buyer ' || cast(s_suppkey as varchar) end as ORDERS_FROM
        from supplier""",
    "inv_vendor_map": f"""
        select {_VENDOR} as VENDOR_CODE, BRAND_CODE from supplier, inv_brand
        where s_suppkey % 25 + 1 = cast(BRAND_CODE as int)""",
    "inv_product": f"""
        select {_PART_CODE} as PRODUCT_CODE, p_name as PRODUCT_TITLE, {_BRAND} as BRAND_CODE, '1 pack' as PACK_INFO,
               case when p_partkey % 8 = 0 then 'Y' else 'N' end as ORDER_BY_SIZE
        from part where p_partkey % 4 = 0""",
    "inv_product_map": f"""
        select {_PART_CODE.replace('p_partkey', 'PARTKEY')} as PRODUCT_CODE, STD_SKU
        from inv_inventory where PARTKEY % 40 < 32""",
    "inv_manufacturing_map": """
        select PRODUCT_CODE, STD_SKU, 'M' || PRODUCT_CODE || if(STD_SKU like '%-C3-%', 'B', '') as MANUFACTURING_CODE, 'Mfg ' || PRODUCT_CODE as MANUFACTURING_TITLE,
               case when STD_SKU like '%-C1-%' then '' else 'mfg ' || STD_SKU end as MANUFACTURING_COLOR
        from inv_product_map
        where STD_SKU like 'P%' and substr(PRODUCT_CODE, 6, 2) in ('00','04','20','44','60')""",
    "inv_image": """
        select PARTKEY * 100 + n_nationkey as IMAGE_ID, STD_SKU as SKU,
               'http://img.example.test/' || cast(PARTKEY * 100 + n_nationkey as varchar) as IMAGE_PATH, 'src' as IMAGE_SOURCE
        from inv_inventory join nation on n_nationkey < if(PARTKEY % 7 = 0, 0, PARTKEY % 13)""",
    "inv_listing": f"""
        select p_partkey * 100 + MARKET_ID * 10 + b.r_regionkey as LISTING_ITEM_ID, i.STD_SKU, MARKET_ID,
               {_LISTING_SKU} as LISTING_SKU, p_name || ' listing' as LISTING_PRODUCT_NAME,
               b.r_regionkey + 1 as LISTING_PRODUCT_QTY, p_retailprice as LISTING_PRODUCT_PRICE, 'N' as LISTING_PRODUCT_FBM,
               case when p_partkey % 50 = 6 then 'bad' else '20240131235959' end as CREATED_DTTM,
               case when p_partkey % 11 = 0 then 'N' else 'Y' end as VALID_YN
        from part cross join (from inv_market where MARKET_ID <= 8) cross join region b
        join inv_inventory i on i.PARTKEY = case when p_partkey % 20 = 0 and b.r_regionkey = 1 then 1 else p_partkey end
        where p_partkey % 10 < 7
          and (b.r_regionkey = 0 or (b.r_regionkey = 1 and (p_partkey % 20 = 0 or p_partkey % 30 = 3)))""",
    "inv_unlink_listing": f"""
        select p_partkey * 10 + MARKET_ID as LISTING_ITEM_ID, MARKET_ID, {_LISTING_SKU} as LISTING_SKU,
               p_name || ' unlinked' as LISTING_PRODUCT_NAME, cast(p_size as varchar) as LISTING_PRODUCT_SIZE,
               p_type as LISTING_PRODUCT_COLOR, p_type as LISTING_PRODUCT_DESIGN,
               case when p_partkey % 19 = 0 then 'N' else 'Y' end as VALID_YN
        from part cross join (from inv_market where MARKET_ID <= 8) where p_partkey % 10 >= 6""",
    "inv_order": """
        select cast(o_orderkey as varchar) as CHANNEL_ORDER_NO, cast(o_custkey % 8 + 1 as int) as MARKET_ID,
               replace(cast(cast(o_orderdate as date) as varchar), '-', '') as ORDER_DATE, 1 as ORDER_QTY,
               o_totalprice as ORDER_PRICE, cast(0 as double) as ORDER_SHIPPING_PRICE, cast(0 as double) as SHIPPING_PRICE,
               case o_orderstatus when 'F' then '01' when 'P' then '02' else null end as SHIPPING_STATUS,
               lpad(cast(o_orderkey as varchar), 22, '0') as TRACKING_NO,
               case when o_orderstatus = 'O' then null else cast(o_custkey as varchar) end as EMPLOYEE_ID,
               case when o_orderstatus = 'O' then null
                    else replace(cast(cast(cast(o_orderdate as date) + interval '1' day as date) as varchar), '-', '') end as PROC_DT,
               case when o_orderstatus = 'O' then null else '134501' end as PROC_TM
        from orders""",
    "inv_order_item": f"""
        select cast(l_orderkey as varchar) as CHANNEL_ORDER_NO, cast(o_custkey % 8 + 1 as int) as MARKET_ID,
               {_LISTING_SKU} as LISTING_SKU, p_retailprice as UNIT_PRICE, cast(l_quantity as int) as UNIT_QTY,
               '00' as PACKING_STATUS, case l_returnflag when 'R' then 'Y' when 'A' then 'N' else null end as NO_ITEM_YN,
               case when l_linestatus = 'F' and l_returnflag = 'A' then 'Y' else null end as TAG_CHANGE_YN
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "inv_user": """
        select cast(c_custkey as varchar) as EMPLOYEE_ID, case when c_custkey % 7 = 0 then null else c_name end as FIRST_NAME,
               '' as MIDDLE_NAME, case when c_custkey % 5 = 0 then null else c_mktsegment end as LAST_NAME,
               c_mktsegment as DEPARTMENT_NAME, '20240101000000' as LAST_LOGIN_DTTM
        from customer where c_custkey % 3 <> 0""",
    "inv_product_order": f"""
        select case when l_orderkey % 97 <> 0 then strftime(l_shipdate, '%Y') || lpad(cast(i.PARTKEY // 4 % 12 + 1 as varchar), 2, '0') || '15' end as ORDER_DATE,
               case when l_orderkey % 89 <> 0 then (year(l_shipdate) - 1990) * 12 + i.PARTKEY // 4 % 12 + 1 end as ORDER_SEQ, i.STD_SKU,
               m.PRODUCT_CODE,
               case when l_linenumber % 2 = 0 then lpad(substr(i.PRODUCT_SUPPLIER, 7), 2, '0') else null end as BRAND_CODE,
               case when l_linenumber % 2 = 0 then null else {_VENDOR.replace('s_suppkey', 'l_suppkey')} end as VENDOR_CODE,
               cast(l_quantity as int) as ORDER_QTY, '101500' as ORDER_TM, cast(l_orderkey % 150 as varchar) as EMPLOYEE_ID
        from lineitem join inv_inventory i on i.PARTKEY = l_partkey join inv_product_map m on m.STD_SKU = i.STD_SKU""",
    # Feeds
    "req_packing": f"""
        select l_orderkey * 10 + l_linenumber as REQUEST_SEQ, cast(l_orderkey as varchar) as CHANNEL_ORDER_NO,
               cast(o_custkey % 8 + 1 as int) as MARKET_ID,
               case when l_suppkey % 5 = 0 then '' else cast(l_suppkey as varchar) end as EMPLOYEE_ID,
               case when l_linestatus = 'F' then 'Y' else 'N' end as COMPLETE_YN,
               case when l_returnflag = 'R' then 'Y' end as HOLD_YN,
               {_LISTING_SKU} as LISTING_SKU, cast(l_quantity as int) as UNIT_QTY,
               case when l_returnflag = 'R' then 'Y' else 'N' end as NO_ITEM_YN,
               case l_suppkey % 4 when 0 then 'Y' when 1 then 'N' end as TAG_CHANGE_YN
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "req_employee": """
        select c_custkey as REQUEST_SEQ,
               case when c_custkey % 10 = 3 then '' else cast(c_custkey - c_custkey % 2 as varchar) end as EMPLOYEE_ID,
               case when c_custkey % 4 < 2 then 'New ' || cast(c_custkey as varchar) else '' end as FIRST_NAME,
               case when c_custkey % 6 = 0 then 'M' end as MIDDLE_NAME,
               case when c_custkey % 5 = 0 then null else 'Last ' || cast(c_custkey as varchar) end as LAST_NAME,
               case when c_custkey % 2 = 0 then c_mktsegment else '' end as DEPARTMENT_NAME
        from customer""",
    "req_punch": """
        select cast(user_id as varchar) as EMPLOYEE_ID,
               substr(strftime(ts, '%Y%m%d%H%M%S'), 1, case when event_id % 50 = 0 or event_type = 'error' then 13 else 14 end) as PUNCH_DTTM
        from events""",
    "req_order_line": f"""
        select PARTKEY % 3 as BATCH, '20240201' as ORDER_DATE, i.STD_SKU, m.PRODUCT_CODE, {_BRAND} as BRAND_CODE, cast(null as varchar) as VENDOR_CODE,
               cast(p_partkey % 10 + 1 as int) as ORDER_QTY, '101500' as ORDER_TM, cast(p_partkey % 150 as varchar) as EMPLOYEE_ID
        from part join inv_inventory i on PARTKEY = p_partkey join inv_product_map m on m.STD_SKU = i.STD_SKU""",
}


def with_views(query: str, extra: dict[str, str] | None = None) -> str:
    """The query with the views it uses, and those they use, as leading CTEs."""
    views = {**VIEWS, **(extra or {})}
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                add(views[name])

    add(query)
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in views:
            if other != name and re.search(rf"\b{other}\b", views[name]):
                place(other)
        order.append(name)

    for name in views:
        if name in needed:
            place(name)
    ctes = ",\n".join(f"{name} as ({views[name]})" for name in order)
    return f"with {ctes}\n{query}" if ctes else query
