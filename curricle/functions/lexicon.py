"""Known skills and certificates."""

#: Fixed values.
SKILLS = [
    "C语言", "Docker", "Elasticsearch", "Excel", "Flink", "Git", "HTML/CSS", "Hive", "JMeter", "Java", "JavaScript", "Kafka",
    "Kubernetes", "Linux", "MongoDB", "MyBatis", "MySQL", "Nginx", "Office办公软件", "PPT", "Pandas", "Python", "Python爬虫",
    "RabbitMQ", "React", "Redis", "SPSS", "Selenium", "Shell", "Spark", "Spring Boot", "Spring Cloud", "Vue", "Word", "会议组织",
    "公文写作", "办公自动化", "发票管理", "员工入离职办理", "固定资产盘点", "基础会计", "微服务", "成本核算", "报表编制", "招聘渠道维护",
    "数据结构", "机器学习", "档案管理", "社保公积金办理", "税务申报", "考勤统计", "自动化测试", "薪酬核算", "财务核算", "预算管理",
]

#: Fixed values.
CERTIFICATES = [
    "C1驾驶证", "CET-4", "CET-6", "PMP", "中级会计职称", "人力资源管理师三级", "初级会计职称", "初级经济师", "普通话二级甲等",
    "计算机三级", "计算机二级", "软考中级（软件设计师）", "软考高级（系统分析师）",
]
